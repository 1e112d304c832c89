"""Guards: what must not hold, as rows that must be none, and checks of recorded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ViolationError(ValueError):
    """A guard found rows."""


def shared_keys(rows: DataFrame, role: str, keys: list[str]) -> DataFrame:
    """Key values that occur in more than one role, or are null: key, value, roles."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("k")
    return rows.select(role, each).select(role, "k.*").groupBy("key", "value").agg(F.count_distinct(role).alias("roles")).where("roles > 1 or value is null or value = ''")


def not_clean(rows: DataFrame, is_anomaly: str, origin: str, origin_value: str, class_id: str, classes: range) -> DataFrame:
    """Rows that are not clean normal ones: an anomaly, of another origin, or of a class outside the range; nulls count as such."""
    clean = (F.col(is_anomaly) == 0) & (F.col(origin) == origin_value) & F.col(class_id).between(classes.start, classes.stop - 1)
    return rows.where(~F.coalesce(clean, F.lit(False)))


#: Rows whose hashes one task joins.
HASHES = 100_000


def fingerprint(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """keys and the digest of all their rows' hashes (hex strings): a tree of sha256 over the sorted hashes of each prefix.

    Leaves are prefixes of as many digits as HASHES rows a leaf take, three at least; each level joins the sixteen digests, or at
    the top all of three digits, below it. A few digits decide how a leaf is cut, never what it holds.
    """
    digits, n = 3, rows.count()
    while n / 16**digits > HASHES:
        digits += 1
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    level = rows.where(F.col(h).isNotNull()).groupBy(*keys, F.substring(h, 1, digits).alias("part")).agg(joined(F.array_sort(F.collect_list(h))).alias("digest"))
    whole = joined(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x.getField("digest"))).alias("digest")
    for d in range(digits - 1, 2, -1):
        level = level.groupBy(*keys, F.substring("part", 1, d).alias("to")).agg(whole).withColumnRenamed("to", "part")
    return level.groupBy(*keys).agg(whole)


def missing(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of part that whole lacks: none for a subset."""
    return part.select(*keys).join(whole.select(*keys).distinct(), keys, "left_anti")


def spread(rows: DataFrame, inner: str, outer: str) -> DataFrame:
    """Inner groups that lie in more than one outer group."""
    return rows.groupBy(inner).agg(F.count_distinct(outer).alias("outers")).where("outers > 1")


def none(violations: DataFrame, what: str) -> None:
    """Raise if there is any violation."""
    found = violations.limit(1).collect()
    if found:
        raise ViolationError(f"{what}: {found[0].asDict()}")


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def checks(**conditions: Column) -> Column:
    """An array of (check, ok) from named conditions; null is not ok."""
    return F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in conditions.items()))
