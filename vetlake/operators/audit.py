"""Inventory reports: histograms, distributions, groups, leakage, outliers, label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import group_digest
from ..functions.robust import MAD
from .selection import quantiles


def histogram(rows: DataFrame, *by: str, drop_null: bool = True) -> DataFrame:
    """Counts of each value; null values are left out unless asked for."""
    if drop_null:
        rows = rows.na.drop(subset=list(by))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def group_sizes(rows: DataFrame, by: str) -> DataFrame:
    """How many groups have each size."""
    return histogram(rows, by).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("groups"))


def duplicate_groups(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Groups of two and more rows with equal keys: the key, members, first name and the digest of the names."""
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.min(name).alias("first"), F.collect_list(name).alias("names"))
    return out.where("members > 1").select(key, "members", "first", group_digest(F.col("names")).alias("group_id"))


def class_distribution(rows: DataFrame, class_column: str, source: str, split: str | None = None) -> DataFrame:
    """Rows, distinct contents and sources of each class; classes that are null are left out."""
    aggregates = [F.count(F.lit(1)).alias("rows"), F.count_distinct("sha256").alias("contents"), F.count_distinct(source).alias("sources"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies")]
    return rows.where(F.col(class_column).isNotNull()).groupBy(class_column).agg(*aggregates)


def imbalance(counts: DataFrame, n: str = "n") -> DataFrame:
    """The largest class as a share of all, and as a multiple of the smallest (null if that is empty)."""
    return counts.agg(F.max(n).alias("largest"), (F.max(n) / F.sum(n)).alias("largest_share"), (F.max(n) / F.nullif(F.min(n), F.lit(0))).alias("largest_to_smallest"))


def spanning(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one known value: leakage for splits, conflicts for labels."""
    known = rows.where(F.col(value).isNotNull() & (F.col(value) != "unknown"))
    return known.groupBy(group).agg(F.count_distinct(value).alias("n_values"), F.array_join(F.array_sort(F.collect_set(value)), "|").alias("values")).where("n_values > 1")


def outlier_flag(rows: DataFrame, value: str, where: Column, least: int = 5, floor: float = 20.0, factor: float = 4.5) -> DataFrame:
    """rows with `outlier`: among those that `where` names, a value far from their median by floor and by robust deviations.

    Never with fewer than `least` such rows.
    """
    own = rows.where(where)
    first = quantiles(own, [], {"__m": (value, 0.5)}).crossJoin(own.agg(F.count(value).alias("__n")))
    mad = quantiles(own.crossJoin(F.broadcast(first)).select(F.abs(F.col(value) - F.col("__m")).alias("gone")), [], {"__d": ("gone", 0.5)})  # one row
    out = rows.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(mad))
    far = F.abs(F.col(value) - F.col("__m")) > F.greatest(F.lit(floor), F.lit(factor * MAD) * F.col("__d"))
    return out.withColumn("outlier", F.coalesce(where & (F.col("__n") >= least) & far, F.lit(False))).drop("__m", "__n", "__d")


def flags(**conditions: Column) -> Column:
    """The names of the conditions that hold."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())), lambda x: x.isNotNull())


def label_report(labels: DataFrame, files: DataFrame, key: str, split: str) -> DataFrame:
    """One row: label rows, distinct keys, repeats, keys in several splits, labels without files."""
    each = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(split).alias("splits"))
    absent = each.join(files.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("absent"))
    out = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - 1)), F.lit(0)).alias("repeats"),
        F.count_if(F.col("splits") > 1).alias("in_several_splits"),
    )
    return out.crossJoin(absent)  # one row each
