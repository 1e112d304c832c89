"""A corpus pipeline of five stages: each calls one operator on all that its predecessor kept.

1. toxicity: documents whose class-conditional Kneser-Ney score is 0.5 or more go.
2. ngram_jaccard: one document of each class of near-duplicates stays.
3. substring_dedup: passages of 50 words and more that repeat across documents are cut from all but the first.
4. decontamination: documents that the contamination rule names go.
5. packing: what is left, as pieces in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetlake.llm import decontaminate, packing, toxicity
from vetlake.llm.common import Scratch
from vetlake.llm.jaccard_join import keep_first
from vetlake.llm.substring_dedup import cut_repeats

#: SQL has no learned models, alignments or tokenizers: the stages are tested one by one.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    return packing.pack(docs, end=1).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", not_contaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
