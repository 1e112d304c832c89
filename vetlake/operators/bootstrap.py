"""Cluster bootstrap of the rank auroc: whole units are drawn with replacement, with exact multinomial counts.

Units stand at the leaves of a binary tree, by the bits of a hash. A replicate's draws go down it: of the m draws at a node the left
side gets a binomial count, by inversion at a uniform number that a hash of replicate and node gives, the right side the rest. So
every replicate draws as many units as there are, and any task can make its own part of the tree. Counts of all replicates are
one array for each unit; rows are joined to them once and are not copied.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..functions.prefix import range_of

#: Bits of a unit's hash, levels of the tree that one task goes down, units of a node that one task holds.
BITS, LEVELS, UNITS = 60, 8, 4096
#: Rows times replicates that one task holds, the most score ranges, and the replicates that it works on at once.
CELLS, MOST, COLUMNS = 1 << 22, 1024, 16
#: Half the width of the values that an inversion looks at, in standard deviations: what is beyond has no weight in a double.
REACH = 40
_SMALL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 257)))))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    big = np.maximum(x, 256).astype(float)
    series = big * np.log(big) - big + 0.5 * np.log(2 * np.pi * big) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(x <= 256, _SMALL[np.minimum(x, 256).astype(int)], series)


def binomial_at(m: int, p: float, u: float) -> int:
    """The least k whose distribution function, of m draws of share p, reaches u."""
    if m == 0 or p <= 0:
        return 0
    if p >= 1:
        return m
    reach = REACH * math.sqrt(m * p * (1 - p)) + REACH
    k = np.arange(max(0, math.floor(m * p - reach)), min(m, math.ceil(m * p + reach)) + 1)
    total = np.cumsum(np.exp(_log_factorial(np.array([m])) - _log_factorial(k) - _log_factorial(m - k) + k * math.log(p) + (m - k) * math.log1p(-p)))
    return int(k[min(np.searchsorted(total / total[-1], u), len(k) - 1)])


def uniform(salt: str, replicate: int, path: str) -> float:
    """A number in (0, 1) for a replicate and a node of the tree."""
    return (int(hashlib.sha256(f"{salt}:{replicate}:{path}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def shared_draws(keys: np.ndarray, sizes: np.ndarray, draws: np.ndarray, depth: int, bits: int, salt: str) -> np.ndarray:
    """Deals a node's draws (one number for each replicate) to its parts: ascending keys of `bits` bits, equal in the first `depth`, and the units in each."""
    out = np.zeros((len(keys), len(draws)), np.int64)
    before = np.concatenate(([0], np.cumsum(sizes)))
    todo = [(0, len(keys), depth, draws)]
    while todo:
        lo, hi, d, m = todo.pop()
        if hi - lo == 1:
            out[lo] = m
            continue
        if d < bits:
            path = format(int(keys[lo]) >> (bits - d), f"0{d}b") if d else ""
            mid = lo + int(np.searchsorted(keys[lo:hi], ((int(keys[lo]) >> (bits - d - 1) | 1) << (bits - d - 1))))
        else:  # hashes that agree in all bits are halved by their order
            path, mid = f"{int(keys[lo])}#{lo}-{hi}", (lo + hi) // 2
        if mid in (lo, hi):
            todo.append((lo, hi, d + 1, m))
            continue
        p = (before[mid] - before[lo]) / (before[hi] - before[lo])
        left = np.array([binomial_at(n, p, uniform(salt, r, path)) for r, n in enumerate(m.tolist())])
        todo += [(lo, mid, min(d + 1, bits), left), (mid, hi, min(d + 1, bits), m - left)]
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _dealt(at: int, to: int, salt: str):
    """A node's draws for its parts some levels further down."""

    def deal(parts: pa.Table, node: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        keys = parts["part"].to_numpy()
        return pa.table({"node": keys, "draws": _lists(shared_draws(keys, parts["n"].to_numpy(), np.array(node["draws"][0].as_py()), at, to, salt))})

    return deal


def unit_draws(rows: DataFrame, unit: str, repeats: int, salt: str = "42") -> DataFrame:
    """unit, times: how often each distinct unit is drawn in each of the replicates; a replicate's draws sum to the number of units.

    Rows without a unit are left out. Draws depend on the salt and the units' names alone.
    """
    key = F.conv(F.substring(F.sha2(F.col("unit").cast("string"), 256), 1, BITS // 4), 16, 10).cast("long")
    units = kept(rows.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit")).distinct().withColumn("key", key), "units")
    n = units.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / UNITS)))
    node = lambda d: F.shiftrightunsigned("key", BITS - d)
    draws = units.sparkSession.createDataFrame([(0, [n] * repeats)], "node long, draws array<long>")
    at = 0
    while at < depth:
        to = min(at + LEVELS, depth)
        parts = units.groupBy(node(to).alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.shiftrightunsigned("part", to - at))
        draws = kept(parts.groupBy("node").cogroup(draws.groupBy("node")).applyInArrow(_dealt(at, to, salt), "node long, draws array<long>"), "draws")
        at = to

    def last(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"unit": a["unit"], "times": pa.array([], pa.list_(pa.int64()))})
        a = a.sort_by([("key", "ascending"), ("unit", "ascending")])
        return pa.table({"unit": a["unit"], "times": _lists(shared_draws(a["key"].to_numpy(), np.ones(a.num_rows, np.int64), np.array(b["draws"][0].as_py()), depth, BITS, salt))})

    kind = dict(units.dtypes)["unit"]
    out = units.withColumn("node", node(depth)).groupBy("node").cogroup(draws.groupBy("node")).applyInArrow(last, f"unit {kind}, times array<long>")
    return out.withColumnRenamed("unit", unit)


def _by_score(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores ascending, with the anomalies and normals of all replicates at each."""
    scores, place = np.unique(table["score"].to_numpy(), return_inverse=True)
    out = []
    for c in ("pos", "neg"):
        flat = table[c].combine_chunks()
        cells = flat.flatten().to_numpy().reshape(len(flat), -1)
        sums = np.zeros((len(scores), cells.shape[1]), np.int64)
        np.add.at(sums, place, cells)
        out.append(sums)
    return scores, *out


def bootstrap_auroc(rows: DataFrame, unit: str, repeats: int, salt: str = "42") -> DataFrame:
    """replicate, auroc by resampling whole units with replacement, ties half; replicates with one class only are null.

    Rows (unit, score, y) without one of the three are left out. Scores are cut into ranges; each range makes its own sums for all
    replicates, and what stands in lower ranges comes from a table of one row for each range and replicate. A range that one
    score crowds is dealt to several tasks, which hand on one row for each score.
    """
    sums = rows.where(F.col(unit).isNotNull()).where("score is not null and y is not null").groupBy(unit, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("n"))
    times = lambda c: F.transform("times", lambda t: t * F.col(c))
    joined = kept(sums.join(unit_draws(rows.where("score is not null and y is not null"), unit, repeats, salt), unit).select(F.col(unit).alias("unit"), F.col("score").cast("double").alias("score"), times("p").alias("pos"), times("n").alias("neg")), "drawn")
    most = max(1, CELLS // repeats)  # rows of a task
    ranges = max(1, min(MOST, -(-joined.count() // most)))
    bounds = []
    if ranges > 1:
        bounds = sorted(set(joined.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10 * MOST)).first()[0]))
    joined = joined.withColumn("part", range_of(F.col("score"), bounds))
    cuts = joined.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).alias("cuts"))
    schema = "part int, score double, pos array<long>, neg array<long>"

    def one_row(t: pa.Table) -> pa.Table:
        scores, pos, neg = _by_score(t)
        return pa.table({"part": np.full(len(scores), t["part"][0].as_py(), np.int32), "score": scores, "pos": _lists(pos), "neg": _lists(neg)})

    dealt = joined.join(cuts, "part").select("part", "score", "pos", "neg", F.pmod(F.xxhash64("unit", "score"), F.col("cuts")).alias("cut"))
    blocks = dealt.groupBy("part", "cut").applyInArrow(one_row, schema)

    def inside(t: pa.Table) -> pa.Table:
        _, pos, neg = _by_score(t)
        within = np.concatenate([(pos[:, c : c + COLUMNS] * (np.cumsum(x, axis=0) - 0.5 * x)).sum(0) for c in range(0, pos.shape[1], COLUMNS) for x in [neg[:, c : c + COLUMNS]]])
        r = pos.shape[1]
        return pa.table({"part": np.full(r, t["part"][0].as_py(), np.int32), "replicate": np.arange(r), "within": within, "pos": pos.sum(0), "neg": neg.sum(0)})

    parts = blocks.groupBy("part").applyInArrow(inside, "part int, replicate long, within double, pos long, neg long")
    lower = F.coalesce(F.sum("neg").over(W.partitionBy("replicate").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    beaten = F.sum(F.col("within") + F.col("pos") * F.col("lower"))
    pairs = F.nullif((F.sum("pos") * F.sum("neg").cast("double")), F.lit(0.0))
    return parts.withColumn("lower", lower).groupBy("replicate").agg((beaten / pairs).alias("auroc"))
