"""Vectors: cosine neighbours, covariance, latent distances, memory banks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import salted
from ..functions.kept import kept

#: Vectors of a block that one task of a neighbour search holds, the chunks in which it compares them, and the digits it ranks by.
BLOCK = 16_384
QUERIES, BANK, DIGITS = 256, 4096, 12
#: States of moments that one task merges.
FAN = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, for unit vectors, cut to [0, 2]."""
    return 1 - F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _nearest(k: int, exclude_self: bool):
    """The k nearest of a block of the bank for each query of a block, in chunks of QUERIES x BANK distances."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, x = left.column("id").to_numpy(), _matrix(left.column("v"))
        order = np.argsort(right.column("k").to_numpy())  # so that ties go by id
        ids, bank = right.column("k").to_numpy()[order], _matrix(right.column("v"))[order]
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(own), QUERIES):
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at in range(0, len(ids), BANK):
                d = np.round(1 - np.clip(x[lo : lo + QUERIES] @ bank[at : at + BANK].T, -1, 1), DIGITS)
                if exclude_self:
                    d[own[lo : lo + QUERIES, None] == ids[None, at : at + BANK]] = np.inf
                last = min(k, d.shape[1]) - 1
                row, col = np.nonzero((d <= np.partition(d, last, axis=1)[:, last : last + 1]) & (d < np.inf))
                found.append((row, d[row, col], ids[at + col]))
            row, d, other = (np.concatenate(c) for c in zip(*found, strict=True))
            best = np.lexsort((other, d, row))
            row, d, other = row[best], d[best], other[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            for c, v in zip(out, (own[lo + row], other, d), strict=True):
                c.append(v[place < k])
        return pa.table({name: np.concatenate(c) for name, c in zip(("id", "other", "distance"), out, strict=True)})

    return run


def cosine_knn(queries: DataFrame, bank: DataFrame, key: str, vector: str, k: int = 5, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """id, other, distance, rank: each query's k nearest vectors of the bank, by cosine distance, ties by id; exact.

    Both sides are dealt in blocks of about `block` vectors; a shuffle brings each block of queries to each block of the bank,
    where a task keeps k candidates for each query. Candidates are merged by rank, before the shuffle too. Nothing is broadcast
    or collected. Distances that agree in DIGITS digits are ties. Null ids and vectors are left out.
    """
    n_blocks = lambda df: max(1, -(-df.count() // block))
    known = lambda df: df.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    rows, own = known(queries), known(bank)
    nq, nb = n_blocks(rows), n_blocks(own)
    deal = lambda n, salt: F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), deal(nq, 1).alias("q"), every(nb).alias("b"))
    right = own.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), deal(nb, 2).alias("b"), every(nq).alias("q"))
    cells = left.groupBy("q", "b").cogroup(right.groupBy("q", "b"))
    near = _nearest(k, exclude_self)
    empty = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    found = cells.applyInArrow(lambda a, b: near(a, b) if a.num_rows and b.num_rows else empty, "id long, other long, distance double")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


_STATE = "part long, n long, mean array<double>, products array<double>"


def _merged(a, b):
    """The state of both parts together, from (n, mean, products); differences of means keep the digits that sums of squares lose."""
    if a is None:
        return b
    (n, mean, products), (m, mean_m, products_m) = a, b
    gap = mean_m - mean
    return n + m, mean + gap * (m / (n + m)), products + products_m + np.outer(gap, gap)[np.triu_indices(len(gap))] * (n * m / (n + m))


def _rows_of(part: int, state) -> pa.RecordBatch:
    n, mean, products = state
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([mean.tolist()]), pa.array([products.tolist()])], names=["part", "n", "mean", "products"])


def _own_state(batches):
    """A partition's vectors as one state."""
    part, state = 0, None
    for batch in batches:
        if batch.num_rows:
            part, x = batch.column(0)[0].as_py(), _matrix(pa.chunked_array([batch.column(1)]))
            rest = x - x.mean(0)
            state = _merged(state, (len(x), x.mean(0), (rest.T @ rest)[np.triu_indices(x.shape[1])]))
    if state is not None:
        yield _rows_of(part, state)


def _joint_state(states: pa.Table) -> pa.Table:
    state = None
    for n, mean, products in zip(states["n"].to_pylist(), _matrix(states["mean"]), _matrix(states["products"]), strict=True):
        state = _merged(state, (n, mean, products))
    return pa.Table.from_batches([_rows_of(states["part"][0].as_py() // FAN, state)])


def moment_state(rows: DataFrame, vector: str) -> DataFrame:
    """One row, none without vectors: n, mean and products, the upper triangle of the summed products around the mean.

    Each partition makes one state, which is written; FAN states at a time are merged, level by level, until one is left. Null
    vectors are left out; all others have one length.
    """
    wide = rows.where(F.col(vector).isNotNull()).select(F.spark_partition_id().cast("long").alias("part"), F.col(vector).cast("array<double>").alias("v"))
    states = kept(wide.mapInArrow(_own_state, _STATE), "moments")
    while states.count() > 1:
        states = kept(states.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(_joint_state, _STATE), "moments")
    return states.drop("part")


def moments(rows: DataFrame, vector: str) -> DataFrame:
    """Covariances (with n - 1) of a vector column's elements: i, j, covariance, and the means; i <= j. One vector has none."""
    state = moment_state(rows, vector)
    size = F.size("mean")
    each = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    pairs = state.select("n", "mean", F.inline(F.arrays_zip(F.flatten(each).alias("at"), F.col("products").alias("p"))))
    mean = lambda end: F.get("mean", F.col(f"at.{end}"))
    return pairs.select(F.col("at.i").alias("i"), F.col("at.j").alias("j"), (F.col("p") / F.nullif(F.col("n") - 1, F.lit(0))).alias("covariance"), mean("i").alias("mean_i"), mean("j").alias("mean_j"))


def fit_latent(rows: DataFrame, vector: str, most: int = 32, shrink: float = 0.1):
    """Mean, components and the inverse of the shrunken covariance, from one state of moments: d * (d + 1) / 2 numbers.

    The covariance of the leading components is shrunk towards its mean variance, 1e-8 at least, so that vectors which are all
    alike have a finite distance too. Fewer than three vectors, or a share outside (0, 1], are a ValueError.
    """
    state = moment_state(rows, vector).first()
    if state is None or state["n"] < 3 or not 0 < shrink <= 1:
        raise ValueError("three vectors and a share in (0, 1] are needed")
    n, mean = state["n"], np.array(state["mean"])
    d = len(mean)
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = np.array(state["products"]) / (n - 1)
    cov += np.triu(cov, 1).T
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: min(most, n - 1, d)]
    spread = np.diag(values[order])
    target = max(np.trace(spread) / len(order), 1e-8)
    return mean, axes[:, order], np.linalg.pinv((1 - shrink) * spread + shrink * target * np.eye(len(order)))


def score_latent(rows: DataFrame, key: str, vector: str, state) -> DataFrame:
    """key and `latent`: the Mahalanobis distance in the fitted components."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        mean, axes, inverse = shared.value
        for batch in batches:
            if batch.num_rows:
                x = (_matrix(pa.chunked_array([batch.column(1)])) - mean) @ axes
                yield pa.record_batch([batch.column(0), pa.array(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x), 0)))], [key, "latent"])

    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, latent double")


def memory_quota(rows: DataFrame, image: str, key: str, quota: int, salt: str = "42") -> DataFrame:
    """At most `quota` rows of each image, in hash order."""
    place = F.row_number().over(W.partitionBy(image).orderBy(salted(F.col(key), salt), key))
    return rows.withColumn("place", place).where(F.col("place") <= quota)


def balanced_memory(rows: DataFrame, image: str, key: str, most: int, salt: str = "42") -> DataFrame:
    """At most `most` rows, one of each image in turn, in hash order."""
    return memory_quota(rows, image, key, most, salt).orderBy("place", image, key).limit(most)


def global_feature(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Each group's mean vector at length one."""
    each = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.getField("m")).alias("v"))  # one entry for each dimension
    return whole.select(group, unit(F.col("v")).alias("feature"))


def top_mean(values: Column, fraction: float, rounding: str = "ceil") -> Column:
    """The mean of an array's largest elements: a fraction of them, rounded up or down, at least one."""
    n = F.size(values) * F.lit(fraction)
    k = F.greatest(F.lit(1), (F.ceil(n - 1e-9) if rounding == "ceil" else F.floor(n + 1e-9)).cast("int"))
    top = F.slice(F.sort_array(F.transform(values, lambda x: x.cast("double")), False), F.lit(1), k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)
