"""The synthetic tables in the roles that the engine's operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored rows: event_id, base_id, event_type, score, y, family, severity."""
    k = F.get_json_object("props", "$.k").cast("int")
    wrong = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("base_id"),
        "event_type",
        F.col("value").alias("score"),
        F.when(wrong, 1).otherwise(0).alias("y"),
        F.when(wrong, F.concat(F.lit("k"), (k % 4).cast("string"))).otherwise("clean").alias("family"),
        F.when(wrong, 1 + k % 3).otherwise(0).alias("severity"),
    )


#: The same as predictions, for DuckDB: begins a WITH list.
PREDICTIONS = """p AS (SELECT event_id, user_id AS base_id, event_type, value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  CASE WHEN event_type = 'error' THEN 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 4 AS VARCHAR) ELSE 'clean' END AS family,
  CASE WHEN event_type = 'error' THEN 1 + CAST(json_extract_string(props, '$.k') AS INT) % 3 ELSE 0 END AS severity FROM events)"""

BRANCH_COLUMNS = {"diffusion": "l_quantity", "semantic": "l_extendedprice", "spectral": "l_discount", "latent": "l_tax"}


def branch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as rows with four branch scores: base_id, line, split_group_id, y, family, severity, and the branches."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("base_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("split_group_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.col("l_linestatus").alias("family"),
        F.col("l_linenumber").alias("severity"),
        *(F.col(c).alias(b) for b, c in BRANCH_COLUMNS.items()),
    )


BRANCHES_SQL = """b AS (SELECT l_orderkey AS base_id, l_linenumber AS line, l_suppkey AS split_group_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_linestatus AS family, l_linenumber AS severity, l_quantity AS diffusion, l_extendedprice AS semantic, l_discount AS spectral, l_tax AS latent FROM lineitem)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an inventory: path, base_id (of the text), sha256, class_name, source_id, value, is_anomaly, quality, label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.join(labels, "doc_id", "left")
    return out.select(
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.col("lang").alias("class_name"),
        F.col("source").alias("source_id"),
        F.col("n_chars").cast("double").alias("value"),
        F.col("toxic").alias("is_anomaly"),
        "quality",
        F.when(F.col("toxic").isNull(), "unknown").when(F.col("toxic") == 1, "anomaly").otherwise("normal").alias("label"),
    )


MANIFEST = """m AS (SELECT d.doc_id, 'doc/' || CAST(d.doc_id AS VARCHAR) AS path, sha256(d.text) AS sha256, d.lang AS class_name, d.source AS source_id,
  CAST(d.n_chars AS DOUBLE) AS value, l.toxic AS is_anomaly, l.quality, CASE WHEN l.toxic IS NULL THEN 'unknown' WHEN l.toxic = 1 THEN 'anomaly' ELSE 'normal' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as images of 8 x 8: case_id, class_id, y, x, v; row-major."""
    each = F.posexplode("embedding").alias("at", "v")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("label").alias("class_id"), each)
    return rows.select("case_id", "class_id", F.expr("at div 8").cast("int").alias("y"), (F.col("at") % 8).alias("x"), F.col("v").cast("double").alias("v"))


PIXELS = """px AS (SELECT vec_id AS case_id, label AS class_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
