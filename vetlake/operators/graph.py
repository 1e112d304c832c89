"""Near-duplicate pairs by Hamming distance, connected components, and groups that keep sources together."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bit_block, bits_as_long
from ..functions.kept import kept


#: Probes of a block that one row makes at most.
PROBES = 1 << 16
#: Strings of a block in a comparison of all pairs, the chunks in which a task compares two blocks, and tasks that share the cells.
BLOCK, ROWS, COLUMNS, TASKS = 1 << 15, 128, 4096, 4096
#: Blocks from which on larger ones are made, not more, and strings of the largest: what a row is copied to, and what a task holds.
WAYS, LARGEST = 12, 1 << 20
#: Strings of a block where only links are kept: fewer cells hand on fewer of them.
FOREST = 1 << 16


def ball(width: int, radius: int) -> int:
    """How many values of `width` bits are at most `radius` bits from one of them."""
    return sum(comb(width, k) for k in range(radius + 1))


def probe_plan(threshold: int, n: int, size: int = 64) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of the blocks that are probed for strings at most `threshold` bits apart, the cheapest for n strings.

    Of m blocks, with threshold = r m + a, one of the first a + 1 differs in at most r bits or one of the others in fewer than r.
    More blocks take fewer probes but let more candidates through; the cost counts both.
    """
    best = None
    for m in range(1, min(threshold + 1, size) + 1):
        radius, over = divmod(threshold, m)
        bounds = [size * i // m for i in range(m + 1)]
        widths = sorted(((hi - lo, lo) for lo, hi in pairwise(bounds)), reverse=True)  # the widest take the larger radius
        blocks = [(lo, width, radius if i <= over else radius - 1) for i, (width, lo) in enumerate(widths)]
        blocks = [(lo, width, r) for lo, width, r in blocks if r >= 0]
        balls = [ball(width, r) for _, width, r in blocks]
        if max(balls) > PROBES:
            continue
        cost = n * sum(balls) + n * n / 2 * sum(b / 2**width for b, (_, width, _) in zip(balls, blocks, strict=True))
        if best is None or cost < best[0]:
            best = cost, blocks
    return best[1]


def near_pairs(rows: DataFrame, key: str, bits: str, threshold: int) -> DataFrame:
    """Pairs a < b of 64-bit strings at most `threshold` bits apart, with their distance.

    Multi-index hashing: each string asks in a few blocks of its bits for every value within the block's radius (probe_plan), so
    that an equi-join of blocks finds every pair. A pair counts in the first block that finds it. Equal strings are joined as one
    and handed to each other only in the end. Null keys and strings are left out.
    """
    rows = kept(rows.where(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(key, bits), "strings")
    one = kept(rows.groupBy(bits).agg(F.min(key).alias("rep")).withColumn("x", bits_as_long(F.col(bits))), "distinct")
    blocks = probe_plan(threshold, one.count())
    masks = [(i, sum(1 << b for b in chosen)) for i, (_, width, r) in enumerate(blocks) for k in range(r + 1) for chosen in combinations(range(width), k)]
    masks = rows.sparkSession.createDataFrame(masks, "block int, mask long")  # PROBES for each block at most
    values = F.array(*(F.struct(F.lit(i).alias("block"), bit_block(F.col("x"), lo, width).alias("value")) for i, (lo, width, _) in enumerate(blocks)))
    each = one.select("rep", "x", F.inline(values))
    asking = each.join(F.broadcast(masks), "block").select("block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), F.col("rep").alias("a"), F.col("x").alias("x_a"))
    asked = each.select("block", "value", F.col("rep").alias("b"), F.col("x").alias("x_b"))
    apart = F.col("x_a").bitwiseXOR(F.col("x_b"))
    first = reduce(lambda later, b: F.when(F.bit_count(bit_block(apart, b[1][0], b[1][1])) <= b[1][2], b[0]).otherwise(later), reversed(list(enumerate(blocks))), F.lit(-1))
    found = asking.join(asked, ["block", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= threshold) & (first == F.col("block")))
    own = rows.join(one.select(bits, "rep"), bits)
    copies = own.where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    return found.select("a", "b", F.bit_count(apart).cast("int").alias("distance")).unionAll(copies)


def _cells(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows with a cell for each pair of blocks that a row's block is in, and the `side` of the cell that it is on (2: both blocks are
    the same), all of a cell in one task and in order of cells.

    Blocks go by a hash of the key, so that copies of a string are spread, and a repeated key stays in one block. A row is copied
    once for each block: beyond WAYS of them blocks grow instead, up to LARGEST rows, so that the shuffle grows with the rows.
    """
    n = rows.count()
    k = max(1, min(-(-n // block), max(WAYS, -(-n // LARGEST))))
    own, other = F.pmod(F.xxhash64(key), F.lit(k)), F.col("other")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    first, second = F.least("own", other), F.greatest("own", other)
    # cells of the triangle are numbered row by row, so that they are dealt evenly
    cell = first * k - F.expr("least(own, other) * (least(own, other) - 1) div 2") + second - first
    side = F.when(F.col("own") == other, 2).otherwise((F.col("own") == second).cast("int")).cast("tinyint")
    dealt = dealt.select(*rows.columns, cell.cast("int").alias("cell"), side.alias("side"))
    cells = k * (k + 1) // 2
    tasks = min(TASKS, cells)
    dealt = dealt.repartitionById(tasks, (F.col("cell") % tasks).cast("int"))
    return dealt.sortWithinPartitions("cell") if tasks < cells else dealt


def _by_cell(batches):
    """(rows of the first block, rows of the second one, None where both are the same) of each cell."""

    def made(parts):
        table = pa.Table.from_batches(parts)
        side = table.column("side")
        table = table.drop_columns(["cell", "side"])
        if side[0].as_py() == 2:
            return table.combine_chunks(), None
        return tuple(table.filter(pc.equal(side, s)).combine_chunks() for s in (0, 1))

    at, parts = None, []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        lo = 0
        for hi in [*(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]:
            if lo < hi:
                if parts and cells[lo] != at:
                    yield made(parts)
                    parts = []
                at = cells[lo]
                parts.append(batch.slice(lo, hi - lo))
            lo = hi
    if parts:
        yield made(parts)


def _near_in(left: pa.Table, right: pa.Table | None, key: str, threshold: int):
    """(all rows of a cell, arrays (row, row, distance) of pairs within the threshold whose first key is the smaller), in chunks."""
    table = left if right is None else pa.concat_tables([left, right])
    rank = pc.rank(table.column(key).combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    x, n = table.column("x").to_numpy().view(np.uint64), left.num_rows
    lowest = 0 if right is None else n

    def chunks():
        for lo in range(0, n, ROWS):
            own = x[lo : min(lo + ROWS, n), None]
            for at in range(lo if right is None else lowest, len(x), COLUMNS):
                apart = np.bitwise_count(own ^ x[None, at : at + COLUMNS])
                i, j = np.divmod(np.flatnonzero(apart <= threshold), apart.shape[1])
                d = apart[i, j]
                i, j = i + lo, j + at
                some = (i < j) & (rank[i] != rank[j])  # repeated keys make no pair
                i, j, d = i[some], j[some], d[some]
                turn = rank[i] > rank[j]
                yield np.where(turn, j, i), np.where(turn, i, j), d

    return table, chunks()


def _pairs_in(key: str, threshold: int):
    """Rows of cells -> rows (a, b, distance)."""

    def run(batches):
        for left, right in _by_cell(batches):
            table, found = _near_in(left, right, key, threshold)
            keys = table.column(key).combine_chunks()
            for i, j, d in found:
                if len(i):
                    yield pa.record_batch([keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(d, pa.int32())], ["a", "b", "distance"])

    return run


def _packed(rows: DataFrame, key: str, bits: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(key, bits_as_long(F.col(bits)).alias("x"))


def _as_cells(rows: DataFrame, key: str, bits: str) -> DataFrame:
    return kept(_packed(rows, key, bits), "strings")


def every_near_pair(rows: DataFrame, key: str, bits: str, threshold: int, block: int = BLOCK) -> DataFrame:
    """a, b, distance: all pairs a < b of rows whose 64-bit strings are at most `threshold` bits apart, copies of a string included.

    For wide thresholds, where no index leaves out much: rows are dealt in blocks of about `block`, a shuffle brings each pair of
    blocks to a task, which compares them in chunks and hands pairs on as it finds them. Time grows with the square of the
    rows; what is shuffled are at most WAYS copies of each, up to WAYS * LARGEST rows; pairs themselves are never shuffled.
    Null keys and strings are left out.
    """
    own = _as_cells(rows, key, bits)
    kind = dict(own.dtypes)[key]
    return _cells(own, key, block).mapInArrow(_pairs_in(key, threshold), f"a {kind}, b {kind}, distance int")


def _counts_in(key: str, label: str, threshold: int):
    """Rows of cells -> a row (pairs, same, cross) for each cell."""

    def run(batches):
        for left, right in _by_cell(batches):
            table, found = _near_in(left, right, key, threshold)
            code = pc.fill_null(table.column(label).combine_chunks().dictionary_encode().indices, -1).to_numpy()
            pairs = same = cross = 0
            for i, j, _ in found:
                known, equal = (code[i] >= 0) & (code[j] >= 0), code[i] == code[j]
                pairs, same, cross = pairs + len(i), same + int((known & equal).sum()), cross + int((known & ~equal).sum())
            yield pa.record_batch([pa.array([n], pa.int64()) for n in (pairs, same, cross)], ["pairs", "same", "cross"])

    return run


def near_pair_counts(rows: DataFrame, key: str, bits: str, label: str, threshold: int, block: int = BLOCK) -> DataFrame:
    """One row: how many pairs every_near_pair has, and how many of them have equal and different labels (null: neither).

    Counted where they are found, so that no pair leaves its task. A key with several rows counts once for each of its labels.
    """
    own = kept(_packed(rows, key, bits).join(rows.select(key, label), key), "strings")  # 8 bytes of a string are shuffled, not its 64 characters
    counts = _cells(own, key, block).mapInArrow(_counts_in(key, label, threshold), "pairs long, same long, cross long")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("pairs", "same", "cross")))


def _forest_in(key: str, threshold: int):
    """Rows of cells -> rows (a, b): each key of a cell that near pairs join to a smaller one, with the least that they join it to."""

    def run(batches):
        for left, right in _by_cell(batches):
            table, found = _near_in(left, right, key, threshold)
            keys = table.column(key).combine_chunks()
            rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64) - 1
            root = np.arange(len(rank))
            for i, j, _ in found:
                x, y = root[rank[i]], root[rank[j]]
                apart = np.flatnonzero(x != y)
                if not len(apart):
                    continue
                joined = np.unique((np.minimum(x[apart], y[apart]) << 32) | np.maximum(x[apart], y[apart]))
                for p, q in zip((joined >> 32).tolist(), (joined & 0xFFFFFFFF).tolist(), strict=True):
                    while root[p] != p:
                        p = root[p]
                    while root[q] != q:
                        q = root[q]
                    root[max(p, q)] = min(p, q)
                while True:  # all point at their root again
                    over = root[root]
                    if (over == root).all():
                        break
                    root = over
            row = np.empty(len(rank), np.int64)
            row[rank] = np.arange(len(rank))
            low = np.unique(rank)
            low = low[root[low] != low]
            yield pa.record_batch([keys.take(pa.array(row[root[low]])), keys.take(pa.array(row[low]))], ["a", "b"])

    return run


def near_forest(rows: DataFrame, key: str, bits: str, threshold: int, block: int = FOREST) -> DataFrame:
    """a, b: links that join the same rows as the pairs of every_near_pair do, one at most for each row of a cell.

    What is written grows with rows times blocks, however many pairs are near.
    """
    own = _as_cells(rows, key, bits)
    kind = dict(own.dtypes)[key]
    return _cells(own, key, block).mapInArrow(_forest_in(key, threshold), f"a {kind}, b {kind}")


def components(nodes: DataFrame, links: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Each node's least node that links (a, b) reach, as `root`.

    Rounds of least neighbour and pointer jumping; each is written once in the shared folder, and they end when no label moves.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = kept(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = kept(nodes.select(F.col(key).alias("node")).where("node is not null").distinct().withColumn("root", F.col("node")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = kept(step.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        labels = step.select("node", F.col("next").alias("root"))
        if not step.where("next <> root").limit(1).count():
            return labels.withColumnRenamed("node", key)
    raise RuntimeError("components did not settle")


def group_ids(rows: DataFrame, key: str, name: str, links: DataFrame) -> DataFrame:
    """key and group_id: sixteen hex digits of the sorted names of its component."""
    from ..functions.keys import group_digest

    labelled = rows.join(components(rows, links, key), key)
    digests = labelled.groupBy("root").agg(group_digest(F.collect_list(name)).alias("group_id"), F.count(F.lit(1)).alias("members"))
    return labelled.select(key, "root").join(digests, "root").select(key, "root", "group_id", "members")


def source_safe_groups(rows: DataFrame, group: str, source: str) -> DataFrame:
    """group and split_root: groups that share a source are one; the graph is bipartite, so links grow with the rows only."""
    pairs = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(source).cast("string").alias("s")).distinct()
    first = pairs.where("s is not null").groupBy("s").agg(F.min("g").alias("b"))
    links = pairs.join(first, "s").select(F.col("g").alias("a"), "b")
    return components(pairs.select("g").distinct(), links, "g").select(F.col("g").alias(group), F.col("root").alias("split_root"))
