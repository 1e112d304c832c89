"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are never learned from; a null id's fold is unknown, so it is held out too."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label (0 or 1) of at most `most` labelled rows that are not held out, picked by a hash of the doc_id.

    Ids labelled twice keep their larger label. `most` bounds what is broadcast and fitted.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
