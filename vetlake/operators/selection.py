"""Exact order statistics by distributed selection: values are counted by range, only the ranges that hold wanted ranks are looked into.

The first pass counts each group's values in ranges of a fixed scale of signed logarithms, with the least and greatest value in each.
While a range that holds a wanted rank has more rows than one task should sort, a pass counts its values in RANGES equal parts, and
the part that holds the rank is the next range. A range of one value is its answer, however many rows have it. What is left is
sorted in one last pass. All groups, columns and ranks share the passes, and each sums before it shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.kept import kept

#: Parts of a range, how many rows of a range are sorted in one task, and ranges of the first pass for a factor of e.
RANGES, SORTED, FINE = 2048, 1 << 18, 256
#: Rows of a state that the driver takes.
FEW = 20_000
_RANGE = ["g", "c", "lo", "hi"]


def _long(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """g (the keys as one value, so that null keys are groups too), c (the column's number), v."""
    g = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    values = (F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))
    return rows.select(g.alias("g"), F.inline(F.array(*values)))


def _log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _asked(long: DataFrame, wanted: list[tuple[int, float, str]]) -> DataFrame:
    """A row for each group, wanted statistic and end of it: the rank k among the n values of [lo, hi], or the value where it is known.

    Infinities and NaN are ranges of their own, at the ends; a group of nulls has one range without values.
    """
    v, inf, end = F.col("v"), float("inf"), 1 << 30
    scale = F.when(F.isnan(v), end).when(v == inf, end - 1).when(v == -inf, -end).otherwise(F.floor(_log(v) * FINE)).cast("int")
    counted = long.groupBy("g", "c", F.when(v.isNotNull(), scale).alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    own = W.partitionBy("g", "c")
    counted = counted.withColumns({"before": F.sum("n").over(own.orderBy("bin")) - F.col("n"), "total": F.sum("n").over(own)})
    asks: dict[int, list[Column]] = {}
    for w, (c, q, kind) in enumerate(wanted):
        place = F.lit(q) * (F.col("total") - 1) if kind == "linear" else F.greatest(F.ceil(F.lit(q) * F.col("total")) - 1, F.lit(0)).cast("double")
        for side, k in enumerate((F.floor(place), F.ceil(place))):
            asks.setdefault(c, []).append(F.struct(F.lit(w).alias("w"), F.lit(side).alias("side"), (place - F.floor(place)).alias("part"), k.cast("long").alias("k")))
    rows = counted.select("*", F.inline(F.get(F.array(*(F.array(*asks[c]) for c in sorted(asks))), F.col("c")))).withColumn("k", F.col("k") - F.col("before"))
    rows = rows.where((F.col("total") == 0) | F.col("k").between(0, F.col("n") - 1))
    one = F.coalesce(~(F.col("lo") < F.col("hi")), F.lit(True))
    return rows.select("g", "c", "w", "side", "part", "k", "lo", "hi", "n", (~one).alias("open"), F.when(one, F.col("lo")).alias("value"))


def _inside(long: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values in each range, with its bounds. A group has as many ranges as wanted ranks at most."""
    own = ranges.select(*_RANGE).distinct().groupBy("g", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return long.where("v is not null").join(own, ["g", "c"]).select("g", "c", "v", F.inline("ranges")).where("v between lo and hi")


def _narrowed(long: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with each range replaced by the part of it that holds the rank; a range's ends are close on the logarithmic scale by now."""
    at = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    counted = _inside(long, asked).groupBy(*_RANGE, F.least(F.floor(at * RANGES), F.lit(RANGES - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
    before = F.sum("inside").over(W.partitionBy(*_RANGE).orderBy("bin")) - F.col("inside")  # RANGES rows at most
    counted = counted.withColumn("before", before)
    step = asked.join(counted, _RANGE).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("inside")))
    one = F.col("low") == F.col("high")
    return step.select("g", "c", "w", "side", "part", (F.col("k") - F.col("before")).alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("inside").alias("n"), (~one).alias("open"), F.when(one, F.col("low")).alias("value"))


def _sorted(long: DataFrame, asked: DataFrame) -> DataFrame:
    """g, w, side, part, value of ranges of SORTED rows at most."""
    values = _inside(long, asked).groupBy(*_RANGE).agg(F.sort_array(F.collect_list("v")).alias("values"))
    return asked.join(values, _RANGE).select("g", "w", "side", "part", F.get("values", F.col("k").cast("int")).alias("value"))


def _few(df: DataFrame) -> list | None:
    """All rows, if they are FEW at most."""
    rows = df.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def _frame(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A few rows as a table whose size is known: literals, where they are very few."""

    def literal(value, kind) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*(literal(value[f.name], f.dataType).alias(f.name) for f in kind))
        return F.lit(value).cast(kind)

    if 0 < len(rows) <= 100:
        return spark.range(0, 1, 1, 1).select(F.inline(F.array(*(literal(r, schema) for r in rows))))
    return F.broadcast(spark.createDataFrame(rows, schema).coalesce(1))


def _between(ends: dict[int, float | None], part: float) -> float | None:
    a, b = ends[0], ends[1]
    return a if a is None or a == b or (a != a and b != b) else a + (b - a) * part


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple]) -> DataFrame:
    """keys and one column for each wanted statistic: name -> (column, share) or (column, share, "lower").

    A statistic is interpolated between its two neighbours in rank or, as "lower", the least value that so large a share of the
    rows does not exceed. Nulls are left out, NaN is larger than all other values; of nothing but nulls a statistic is null. Keys
    may be null. Without keys there is one row. Runs its passes at once. What passes hand on is two rows for each group and
    statistic: up to FEW of them take the way over the driver, more are written.
    """
    columns = sorted({w[0] for w in wanted.values()})
    long = _long(rows, keys, columns)
    first = _asked(long, [(columns.index(c), q, *(how or ["linear"])) for c, q, *how in wanted.values()])
    asked = _few(first)
    if asked is None:
        return _many(long, kept(first, "asked"), keys, list(wanted))
    found: dict = {}
    spark, schema = rows.sparkSession, first.schema
    settle = lambda r: found.setdefault(r["g"], {}).setdefault(r["w"], ({}, r["part"]))[0].__setitem__(r["side"], r["value"])
    while True:
        for r in asked:
            if not r["open"]:
                settle(r)
        asked = [r for r in asked if r["open"]]
        large = [r for r in asked if r["n"] > SORTED]
        if not large:
            break
        asked = [r for r in asked if r["n"] <= SORTED] + _narrowed(long, _frame(spark, large, schema)).collect()
    if asked:
        for r in _sorted(long, _frame(spark, asked, schema)).collect():
            settle(r)
    if not keys and not found:
        found[None] = {}
    kinds = StructType([*(rows.schema[k] for k in keys), *(StructField(name, DoubleType()) for name in wanted)])
    out = [(*(g if keys else ()), *(_between(*own[i]) if i in own else None for i in range(len(wanted)))) for g, own in found.items()]
    return _frame(spark, [dict(zip(kinds.names, r, strict=True)) for r in out], kinds)


def _many(long: DataFrame, asked: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The same passes for very many groups: every state is written."""
    found = []
    while True:
        found.append(asked.where("not open").select("g", "w", "side", "part", "value"))
        asked = asked.where("open")
        large = asked.agg(F.max("n")).first()[0]
        if large is None:
            break
        if large <= SORTED:
            found.append(_sorted(long, asked))
            break
        narrowed = _narrowed(long, asked.where(F.col("n") > SORTED))
        asked = kept(narrowed.unionAll(asked.where(F.col("n") <= SORTED).select(*narrowed.columns)), "narrowed")
    own = lambda i, side: F.max(F.when((F.col("w") == i) & (F.col("side") == side), F.col("value")))
    part = lambda i: F.max(F.when(F.col("w") == i, F.col("part")))
    wide = reduce(DataFrame.unionAll, found).groupBy("g").agg(*(F.struct(own(i, 0).alias("a"), own(i, 1).alias("b"), part(i).alias("p")).alias(f"w{i}") for i in range(len(names))))
    value = lambda i: F.when(F.col(f"w{i}.a") == F.col(f"w{i}.b"), F.col(f"w{i}.a")).otherwise(F.col(f"w{i}.a") + (F.col(f"w{i}.b") - F.col(f"w{i}.a")) * F.col(f"w{i}.p"))
    return kept(wide.select(*(F.col("g").getField(k).alias(k) for k in keys), *(value(i).alias(name) for i, name in enumerate(names))), "quantiles")
