"""Running sums that no single task has to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kept import kept

#: Rows of a range that one task sorts, and how many ranges there are at most: beyond that ranges grow, and their sort spills.
ROWS, MOST = 250_000, 1024


def range_of(order: Column, bounds: list) -> Column:
    """How many of the ascending bounds are below a value, by halving."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order <= F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False, rows: int | None = None) -> DataFrame:
    """df with before_<value>: the sum over the key's rows that come earlier in the order.

    df is written once. Its order column is cut at quantiles into ranges of about `rows` rows, ROWS by default; sums of ranges give
    each range its base, so windows run within a range only. (keys, order) must be unique, and order not null.
    """
    df = kept(df, "ordered")
    ranges = max(1, min(MOST, -(-df.count() // (rows or ROWS))))
    bounds = []
    if ranges > 1:
        found = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * MOST)).first()[0]
        bounds = sorted(set(found))
    part = range_of(F.col(order), bounds)
    df = df.withColumn("__part", -part if descending else part)
    sums = df.groupBy(*keys, "__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*keys, "__part", *(F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__base_{v}") for v in values))
    within = W.partitionBy(*keys, "__part").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumns({f"__in_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(bases, [*keys, "__part"])
    out = out.withColumns({f"before_{v}": F.col(f"__base_{v}") + F.col(f"__in_{v}") for v in values})
    return out.drop("__part", *(f"__base_{v}" for v in values), *(f"__in_{v}" for v in values))
