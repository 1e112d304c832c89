"""Splits by groups: hash halves, shares, balanced samples, coverage, exposure; all of them deterministic by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import salted
from ..functions.kept import kept

#: Hex digits of a hash by which groups are counted.
PREFIX = 3


def _ordered(groups: DataFrame, group: str, salt: str) -> DataFrame:
    """Distinct groups with their place in hash order and their number.

    The place comes from a prefix of the hash: counts of prefixes give each its base, so no task sorts all groups.
    """
    own = groups.where(F.col(group).isNotNull()).select(group).distinct().withColumn("__h", salted(F.col(group), salt)).withColumn("__p", F.substring("__h", 1, 3))
    counts = own.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))  # at most 4096
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"), F.sum("__c").over(W.partitionBy()).alias("__n"))
    return own.join(F.broadcast(bases), "__p").withColumn("__place", F.col("__base") + F.row_number().over(W.partitionBy("__p").orderBy("__h"))).drop("__p", "__base")


def hash_halves(rows: DataFrame, group: str, salt: str = "42") -> DataFrame:
    """Each group's half: A for the first half of the groups in hash order, rounded down, else B. Null groups have none."""
    return _ordered(rows, group, salt).select(group, F.when(F.col("__place") <= F.floor(F.col("__n") / 2), "A").otherwise("B").alias("half"))


def grouped_split(rows: DataFrame, group: str, shares: dict[str, float], salt: str = "42") -> DataFrame:
    """Each group's split: shares are of groups, not rows, in hash order; every split rounds to whole groups, the last takes the rest."""
    placed, upto, split = _ordered(rows, group, salt), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        here = F.col("__place") <= F.round(F.lit(upto) * F.col("__n"))
        split = F.when(here, name) if split is None else split.when(here, name)
    return placed.select(group, split.otherwise(names[-1]).alias("assigned_split"))


def balanced(rows: DataFrame, class_column: str, key: str, n: int, salt: str = "42") -> DataFrame:
    """n rows, taken from the classes in turn: within a class by descending hash, in each round classes in order. Null classes are out."""
    place = F.row_number().over(W.partitionBy(class_column).orderBy(salted(F.col(key), salt).desc(), key))
    ranked = rows.where(F.col(class_column).isNotNull()).withColumn("round", place).where(F.col("round") <= n)
    return ranked.orderBy("round", F.col(class_column).cast("string"), key).limit(n)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that comes first."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("__first")).select(*keys, "__first.*")


def hash_sample(rows: DataFrame, key: str, percent: int, salt: str = "42") -> DataFrame:
    """The rows whose key's hash falls in the first percents."""
    value = F.conv(F.substring(salted(F.col(key), salt), 1, 8), 16, 10).cast("long")
    return rows.where(value % 100 < percent)


def _hashed(groups: DataFrame, group: str, attempts: Column) -> DataFrame:
    """Each group once for each attempt, with its hash and the prefix by which hashes are counted."""
    each = groups.select(group, F.explode(attempts).alias("attempt"))
    each = each.withColumn("h", F.sha2(F.concat(F.col("attempt").cast("string"), F.lit(":"), F.col(group).cast("string")), 256))
    return each.withColumn("p", F.substring("h", 1, PREFIX))


def _borders(hashed: DataFrame, shares: list[float]) -> DataFrame:
    """attempt, p0, rest0, p1, rest1, ...: the prefix in which a split's last group stands, and how many of that prefix are still in it.

    Counts of prefixes, at most 16 ** PREFIX for each attempt, are made in one pass and summed up in order.
    """
    counts = hashed.groupBy("attempt", "p").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("attempt")
    counts = counts.withColumns({"upto": F.sum("c").over(w.orderBy("p")), "n": F.sum("c").over(w)})
    last = [F.round(F.lit(share) * F.col("n")) for share in shares]
    here = [(F.col("upto") - F.col("c") < b) & (b <= F.col("upto")) for b in last]
    border = ((F.max(F.when(x, F.col("p"))).alias(f"p{i}"), F.max(F.when(x, b - F.col("upto") + F.col("c"))).alias(f"rest{i}")) for i, (x, b) in enumerate(zip(here, last, strict=True)))
    return counts.groupBy("attempt").agg(*(c for pair in border for c in pair))


def _dealt(hashed: DataFrame, borders: DataFrame, names: list[str]) -> DataFrame:
    """hashed with assigned_split. Only groups in a border's prefix are put in order; a split without groups has no border."""
    rows = hashed.join(borders, "attempt")
    crowded = reduce(lambda a, b: a | b, (F.coalesce(F.col("p") == F.col(f"p{i}"), F.lit(False)) for i in range(len(names) - 1)), F.lit(False))

    def split(place: Column | None) -> Column:
        out = F.lit(names[-1])
        for i, name in reversed(list(enumerate(names[:-1]))):
            inside = F.col("p") < F.col(f"p{i}")
            if place is not None:
                inside = inside | ((F.col("p") == F.col(f"p{i}")) & (place <= F.col(f"rest{i}")))
            out = F.when(inside, name).otherwise(out)
        return out.alias("assigned_split")

    place = F.row_number().over(W.partitionBy("attempt", "p").orderBy("h"))
    ordered = rows.where(crowded).withColumn("place", place)
    kept_columns = [c for c in hashed.columns if c not in ("h", "p")]
    return rows.where(~crowded).select(*kept_columns, split(None)).unionAll(ordered.select(*kept_columns, split(F.col("place"))))


def covered_split(rows: DataFrame, group: str, class_column: str, shares: dict[str, float], attempts: int = 128) -> DataFrame:
    """The first attempt (a salt) whose grouped split has every class in every split: group, assigned_split, attempt.

    All attempts are made at once, over distinct (group, class) pairs, from counts of hash prefixes; no attempt's groups are sorted
    in one task. Without such an attempt the result is empty.
    """
    names, upto, bounds = list(shares), 0.0, []
    for name in names[:-1]:
        upto += shares[name]
        bounds.append(upto)
    pairs = kept(rows.where(F.col(group).isNotNull() & F.col(class_column).isNotNull()).select(group, class_column).distinct(), "pairs")
    groups = pairs.select(group).distinct()
    every = F.sequence(F.lit(0), F.lit(attempts - 1))
    borders = kept(_borders(_hashed(groups, group, every), bounds), "borders")
    placed = _dealt(_hashed(groups, group, every), borders, names)
    seen = placed.join(pairs, group).groupBy("attempt", "assigned_split", class_column).agg(F.lit(1)).groupBy("attempt").agg(F.count(F.lit(1)).alias("seen"))
    classes = pairs.agg(F.count_distinct(class_column)).first()[0]
    good = seen.where(F.col("seen") == classes * len(names)).agg(F.min("attempt")).first()[0]
    one = F.array(F.lit(good).cast("int")) if good is not None else F.array().cast("array<int>")
    return _dealt(_hashed(groups, group, one), borders, names).select(group, "assigned_split", "attempt")


def without_unsafe(rows: DataFrame, group: str, eligible: Column, split: str = "assigned_split") -> DataFrame:
    """rows whose training groups with any row that is not eligible (or unknown) are moved to test."""
    bad = F.max((~F.coalesce(eligible, F.lit(False))).cast("int")).over(W.partitionBy(group))
    return rows.withColumn(split, F.when((F.col(split) == "train") & (bad == 1), "test").otherwise(F.col(split)))


def untouched(rows: DataFrame, consumed: DataFrame, keys: list[str], group: str) -> DataFrame:
    """rows of groups in which no row shares any of its keys with the consumed keys (key, value)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("k")
    used = rows.select(group, each).select(group, "k.*").join(consumed, ["key", "value"], "left_semi").select(group).distinct()
    return rows.join(used, group, "left_anti")


def validation_groups(classes: dict[str, set], share: int = 8) -> list[str]:
    """Validation groups by greedy choice: groups in order, those at even places first, as long as the rest keeps every class.

    One in `share` of the groups is wanted, at least one. The choice is sequential by nature; its input is one small row
    for each group.
    """
    names = sorted(classes)
    every = set().union(*classes.values()) if classes else set()
    want, chosen = max(1, len(names) // share), []
    for name in names[::2] + names[1::2]:
        if len(chosen) == want:
            break
        rest = [classes[n] for n in names if n != name and n not in chosen]
        if set().union(*rest) == every if rest else not every:
            chosen.append(name)
    return chosen


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
