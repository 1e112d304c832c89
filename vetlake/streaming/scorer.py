"""Scores streamed rows with a frozen calibration and counts alerts by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion


def score_stream(rows: DataFrame, state: DataFrame, weights, threshold: float, branches=fusion.BRANCHES) -> DataFrame:
    """Rows with score and flagged: a stream joined with the one-row state, which stays as it was when the stream began."""
    out = fusion.with_z(rows, state, branches, clip=True)
    return out.withColumn("score", fusion.weighted(weights, branches)).withColumn("flagged", F.col("score") > threshold)


def alerts_by_day(rows: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Flagged rows of each day; rows later than the watermark are dropped by Spark."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("flagged").alias("alerts"))


def events_stream(spark, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)
