"""Substring dedup by collinear chaining of shared seeds.

Seeds are k-word shingles picked by winnowing (the least hash of each WINDOW neighbouring ones), so every run of
k + WINDOW - 1 words that two texts share gives both a common seed; the n-th occurrence of a seed in a text meets the n-th
in another, and its first. Each seed joins its documents with its first and its last document, never all pairs. So that no equal passage
is lost by that, each run of `least` words that documents share joins them all with the first document that has it: of the
windows a few words shorter those are picked that are the least of NEAR neighbouring ones, so that each run has one; all
with such a window meet the first document with it, and where that has other words beside it, those that have the same
words beside it meet the first of them. Anchors, which are winnowed shingles of half the length, tell where such windows can be. For each pair of
documents, matches on one diagonal merge into segments, and segments are chained in order in both texts with gap costs,
the best predecessor coming from a Fenwick tree over the first text's positions. Chains are aligned word by word, past
their ends too, and with more words where an alignment has not ended; what is kept are its best stretches of at least `least`
words with `share` of their columns equal.

Rows are told apart by doc_id and, where ids repeat, by a hash of the text beside it; both are in a position: the hash above
its 32 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, column, lean, text_buffers
from .words import MULTIPLIERS, U, WHITE_WORDS, grams, long_grams, mix

WINDOW = 8
#: Words of a gap that a diagonal's segment spans; cost of a word in the gaps of a chain; words past its ends that are aligned at first, and how many times as many next.
SPAN, GAP_COST, MARGIN, GROWTH = 48, 0.25, 64, 8
#: Requests for one text that go together.
TOGETHER = 32
#: Cells of an alignment table that is filled at once; larger gaps are halved.
CELLS = 1 << 14
#: Matches that are merged at once, and columns that are aligned at once.
MATCHES, COLUMNS = 1 << 16, 1 << 18
#: Share of all documents from which on a seed counts as frequent; bounds the list of frequent seeds by seeds of a text / FREQUENT.
FREQUENT = 0.002
#: Neighbouring windows of which one is picked.
NEAR = 5
#: Bits of the map of shared anchors, as a power of two; a full map costs time and loses nothing.
MAP_BITS = 27
#: In the place of a document: a row that counts seeds.
SEED = -(1 << 63)
COUNTED = T.StructType([T.StructField(n, T.LongType(), False) for n in ("key", "doc", "n")])
SEEDS = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("doc", T.LongType(), False), T.StructField("at", T.LongType(), False)])


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position over all texts, seed key) of each text's seeds."""
    g = grams(hashes, k)
    n = len(g)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    stop = first[doc[:n] + 1] - k + 1  # where the text's shingles end
    inside = at < stop
    whole = inside & (at + window <= stop)
    least = np.concatenate((np.where(inside, g, U(0xFFFFFFFFFFFFFFFF)), np.full(window, U(0xFFFFFFFFFFFFFFFF))))
    least = np.where(whole, _sliding(least, window, np.minimum)[:n], U(0))
    most = _sliding(np.concatenate((np.zeros(window - 1, np.uint64), least)), window, np.maximum)[:n]
    chosen = inside & (most == g)
    size = first[1:] - k + 1 - first[:-1]  # texts of fewer shingles are one window
    short = (size > 0) & (size < window)
    if short.any():
        size = size[short]
        begin = np.cumsum(size) - size
        own = np.repeat(first[:-1][short] - begin, size) + np.arange(size.sum())
        chosen[own] = g[own] == np.repeat(np.minimum.reduceat(g[own], begin), size)
    pos = np.flatnonzero(chosen)
    own, value = doc[pos], g[pos]
    if not len(pos):
        return own, pos, value
    # only seeds that a text has more than once need an order; equal ones are neighbours when sorted by text and value as one hash
    both = value + own.astype(np.uint64) * MULTIPLIERS[7]
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    order = order[np.lexsort((pos[order], value[order], own[order]))]
    o, v = own[order], value[order]
    at = np.arange(len(o))
    start = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))) if len(o) else np.zeros(0, bool)
    nth = np.zeros(len(pos), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(start, at, 0))
    key = mix(value + nth * MULTIPLIERS[3])
    # all occurrences also meet the first one in another text, but not those within a run of a repeated word
    more = order[(nth[order] > 0) & (np.diff(pos[order], prepend=0) >= k)]
    return np.concatenate((own, own[more])), np.concatenate((pos, pos[more])), np.concatenate((key, mix(g[pos[more]])))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and, in a position's upper bits, variant of each row."""
    return (column(batch, n).to_numpy(zero_copy_only=False).astype(np.int64) << shift for n, shift in (("doc_id", 0), ("variant", 32)))


def _texts(batches):
    """(document ids, variants, word hashes, first words) of runs of texts."""
    for batch in batches:
        ids, variant = _ids(batch)
        data, offsets = text_buffers(column(batch, "text"))
        for lo, hi in chunks(offsets):
            _, _, hashes, first = WHITE_WORDS(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield ids[lo:hi], variant[lo:hi], hashes, first


def _own_seeds(text, k: int, window: int, frequent, common: bool) -> list[np.ndarray]:
    """(key, doc, at) of the frequent seeds of a run of texts, or of the others."""
    ids, variant, hashes, first = text
    own, pos, key = winnow(hashes, first, k, window)
    often = np.frombuffer(frequent.value, np.uint64)
    some = often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key if len(often) else np.zeros(len(key), bool)
    some = some == common
    own, pos, key = own[some], pos[some], key[some]
    return [key.view(np.int64), ids[own], (pos - first[own]) | variant[own]]


def _rows(cols, schema: T.StructType) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in cols], schema=pa.schema([pa.field(f.name, pa.bool_() if f.dataType == T.BooleanType() else pa.int64(), False) for f in schema]))


def _seeds(k: int, window: int, frequent):
    """Rows (doc_id, text) -> rows (key, doc, at) of the seeds that are not frequent."""

    def run(batches):
        for text in _texts(batches):
            cols = _own_seeds(text, k, window, frequent, False)
            if len(cols[0]):
                yield _rows(cols, SEEDS)

    return run


def _inside(n: int, first: np.ndarray, k: int) -> np.ndarray:
    """Where k words from a place on are of one text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.arange(n) + k <= first[doc[:n] + 1]


def picked(g: np.ndarray, inside: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places whose value is the least of some `window` neighbouring ones inside, that least value at each place).

    Between the inside places of two texts there must be `window` - 1 others at least.
    """
    n = len(g)
    least = np.concatenate((np.where(inside, g, U(0xFFFFFFFFFFFFFFFF)), np.full(window, U(0xFFFFFFFFFFFFFFFF))))
    least = np.where(inside, _sliding(least, window, np.minimum)[:n], U(0))
    most = _sliding(np.concatenate((np.zeros(window - 1, np.uint64), least)), window, np.maximum)[:n]
    return np.flatnonzero(inside & (most == g)), least


def anchors(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position over all texts, key) of shingles that are the least of some `window` < k neighbouring ones of a text; and that least one at each position."""
    g = long_grams(hashes, k)
    pos, least = picked(g, _inside(len(g), first, k), window)
    return pos, g[pos], least


def _sliding(x: np.ndarray, window: int, least) -> np.ndarray:
    """least (a ufunc) of each `window` consecutive values."""
    size = 1
    while size < window:
        step = min(size, window - size)
        x = least(x[: len(x) - step], x[step:])
        size += step
    return x


def _counted(k: int, window: int, long: int, near: int):
    """Rows (doc_id, text) -> rows (key, doc, n): the anchors of each text, doc being whatever tells rows apart, and seeds that
    repeat within a block of texts, with SEED in the place of doc."""

    def run(batches):
        held, size, docs = [], 0, 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(4, FREQUENT * docs / 2)
            return _rows((values[keep].view(np.int64), np.full(keep.sum(), SEED), counts[keep]), COUNTED)

        for ids, variant, hashes, first in _texts(batches):
            pos, key, _ = anchors(hashes, first, long, near)
            told = np.where(variant == 0, ids, mix(ids.view(np.uint64) + mix(variant.view(np.uint64))).view(np.int64))
            yield _rows((key.view(np.int64), told[np.searchsorted(first, pos, "right") - 1], np.ones(len(pos), np.int64)), COUNTED)
            held.append(winnow(hashes, first, k, window)[2])
            size += len(held[-1])
            docs += len(np.unique(ids))
            if size > 1 << 20:
                yield flush()
                held, size, docs = [], 0, 0
        if size:
            yield flush()

    return run


def maps(rows: DataFrame, often: float, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counted anchors and seeds -> (bits: set where the first MAP_BITS bits of a key are those of an anchor that two documents
    have; such anchors that occur `often`, sorted; seeds that do, sorted)."""
    counted = rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("n")).where((F.col("lo") != F.col("hi")) | ((F.col("lo") == SEED) & (F.col("n") >= often)))
    counted = scratch.write(counted.select("key", "n", (F.col("lo") == F.col("hi")).alias("seed")), "anchors")
    slot = counted.where("not seed").select(F.shiftrightunsigned("key", 64 - MAP_BITS).alias("slot"))
    words = slot.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    common = counted.where(F.col("n") >= often).select("key", "seed").toPandas()  # bounded: see FREQUENT
    scratch.drop("anchors")
    seed, key = common["seed"].to_numpy(bool), common["key"].to_numpy(np.int64).view(np.uint64)
    return out, np.sort(key[~seed]), np.sort(key[seed])


def windows(hashes: np.ndarray, first: np.ndarray, near: np.ndarray, size: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position over all texts, key) of the picked windows of `size` words that begin up to `before` words before one of `near`.

    Of a window that overlaps itself (in runs of repeated words) those stay that cover the run.
    """
    text = np.searchsorted(first, near, "right") - 1
    mark = np.bincount(np.maximum(near - before, first[text]), minlength=len(hashes) + 1) - np.bincount(near + 1, minlength=len(hashes) + 1)
    g = long_grams(hashes, size)
    pos = picked(g, _inside(len(g), first, size), NEAR)[0]
    pos = pos[np.cumsum(mark)[pos] > 0]
    own, key = np.searchsorted(first, pos, "right") - 1, g[pos]
    if not len(pos):
        return own, pos, key
    order = np.lexsort((pos, key, own))
    o, v, p = own[order], key[order], pos[order]
    begin = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]) | (np.diff(p) >= size)))
    lo = np.flatnonzero(begin)
    hi = np.append(lo[1:], len(p)) - 1
    run = np.cumsum(begin) - 1
    since, until = p - p[lo][run], p[hi][run] - p
    half = since // (size // 2)
    stay = begin | np.isin(np.arange(len(p)), hi)
    # at both ends of a run also those that differ in the words beside them, up to the first that has only words of the run there
    stay[1:] |= (half[1:] != half[:-1]) | (since[:-1] < NEAR - 1)
    stay[:-1] |= until[1:] < NEAR - 1
    stay = order[stay]
    return own[stay], pos[stay], key[stay]


def beside(hashes: np.ndarray, first: np.ndarray, own: np.ndarray, pos: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the words before and after it: 16 bits each for the first, the first two, ... NEAR - 1 words; 0 beyond the text."""
    sides = []
    for step, at, stop in ((-1, pos - 1, first[own]), (1, pos + size, first[own + 1] - 1)):
        total, out = np.zeros(len(pos), np.uint64), np.zeros(len(pos), np.uint64)
        for n in range(NEAR - 1):
            place = at + step * n
            there = (place >= stop) if step < 0 else (place <= stop)
            total = mix(total + hashes[np.clip(place, 0, len(hashes) - 1)])
            out |= np.where(there, (total & U(0xFFFF)) | U(1), U(0)) << U(16 * n)
        sides.append(out)
    return sides[0], sides[1]


PICKED = T.StructType([T.StructField(n, T.LongType(), False) for n in ("key", "doc", "at", "left", "right")])
BOTH = T.StructType([*PICKED.fields, T.StructField("seed", T.BooleanType(), False)])


def _own_windows(text, k: int, window: int, size: int, shared, common: bool) -> list[np.ndarray]:
    """(key, doc, at, left, right): windows of `size` words, of a run of texts, around anchors that the map has.

    Those whose least anchor occurs often are given with `common`, the others without.
    """
    bits, often = (np.frombuffer(x, np.uint64) for x in shared.value)
    ids, variant, hashes, first = text
    pos, key, least = anchors(hashes, first, k, window)
    slot = key >> U(64 - MAP_BITS)
    near = pos[(bits[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == 1]
    own, pos, key = windows(hashes, first, near, size, window - 1)
    some = np.isin(least[pos], often) == common
    own, pos, key = own[some], pos[some], key[some]
    left, right = beside(hashes, first, own, pos, size)
    return [key.view(np.int64), ids[own], (pos - first[own]) | variant[own], left.view(np.int64), right.view(np.int64)]


def _windows(k: int, window: int, size: int, shared):
    """Rows (doc_id, text) -> rows (key, doc, at, left, right) of the windows that are not common."""

    def run(batches):
        for text in _texts(batches):
            cols = _own_windows(text, k, window, size, shared, False)
            if len(cols[0]):
                yield _rows(cols, PICKED)

    return run


def _frequent(seeds: tuple, picks: tuple):
    """Rows (doc_id, text) -> rows (key, doc, at, left, right, seed): frequent seeds and common windows, from one pass over the texts."""

    def run(batches):
        for text in _texts(batches):
            cols = _own_seeds(text, *seeds, True)
            none = np.zeros(len(cols[0]), np.int64)
            for made, seed in (([*cols, none, none], True), (_own_windows(text, *picks, True), False)):
                if len(made[0]):
                    yield _rows([*made, np.full(len(made[0]), seed)], BOTH)

    return run


def _led(rows: DataFrame, group: dict[str, Column], keep: Column, spread: bool) -> DataFrame:
    """rows with aggregates of all rows of their key, where `keep` holds for those.

    One sort and no join for keys that few rows have; with `spread`, for keys that very many may have, sums are partial before the
    shuffle and the join can be split. Both spill, which a hash table of a partition's groups could not.
    """
    if not spread:
        own = Window.partitionBy("key")
        return rows.select("*", *(c.over(own).alias(n) for n, c in group.items())).where(keep)
    lead = rows.groupBy("key").agg(*(c.alias(n) for n, c in group.items())).where(keep)
    return rows.join(lead.hint("merge"), "key")


def _met(rows: DataFrame, spread: bool) -> DataFrame:
    """Picked windows -> rows (a, b, pa, pb, key): pairs with the first document of a window; or, with a key and no pair, those
    with other words beside it than that one has: one row for each way that adds NEAR - 1 words."""
    text = lambda at: F.shiftright(at, 32)
    group = {"f": F.min(F.struct("doc", "at", "left", "right")), "last": F.max(F.struct("doc", text("at").alias("text")))}
    met = _led(rows, group, (F.col("f.doc") != F.col("last.doc")) | (text("f.at") != F.col("last.text")), spread)
    met = met.where((F.col("doc") != F.col("f.doc")) | (text("at") != text("f.at")))
    row = lambda a, b, pa_, pb, key: F.struct(*(x.cast("long").alias(n) for x, n in zip((a, b, pa_, pb, key), ("a", "b", "pa", "pb", "key"), strict=True)))
    part = lambda side, n: F.shiftrightunsigned(side, 16 * (n - 1)).bitwiseAND(F.lit(0xFFFF)) if n else F.lit(1)
    none, ways = F.lit(None), [row(F.col("f.doc"), F.col("doc"), F.col("f.at"), F.col("at"), F.lit(None))]
    for n in range(NEAR):
        l, r = part("left", n), part("right", NEAR - 1 - n)
        other = (l != part("f.left", n)) | (r != part("f.right", NEAR - 1 - n))
        ways.append(F.when((l > 0) & (r > 0) & other, row(none, F.col("doc"), none, F.col("at") - n, F.xxhash64("key", F.lit(n), l, r))))
    return met.select(F.explode(F.array(*ways)).alias("m")).where("m is not null").select("m.*")


def merged(pair: np.ndarray, pa_: np.ndarray, pb: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches of numbered pairs -> (pair of each segment, segments (begin in a, begin in b, words)): runs on one diagonal, by pair and in order of b."""
    order = np.lexsort((pb, pb - pa_, pair))
    p, x, y = pair[order], pa_[order], pb[order]
    turn = np.concatenate(([True], (np.diff(y - x) != 0) | (np.diff(p) != 0)))
    far = np.cumsum(turn) << 40  # one diagonal's ends never exceed the next one's
    end = np.maximum.accumulate(far + y + words[order])
    cut = turn.copy()
    cut[1:] |= (far + y)[1:] - end[:-1] > SPAN - k
    lo = np.flatnonzero(cut)
    hi = np.concatenate((lo[1:], [len(x)])) - 1
    out = np.stack((x[lo], y[lo], end[hi] - far[hi] - y[lo]), 1)
    order = np.lexsort((out[:, 0], out[:, 1], p[lo]))
    return p[lo][order], out[order]


class Fenwick:
    """Greatest value of a prefix, with what it came from."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Over places below i."""
        out = (-1e18, -1)
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chain(segs: np.ndarray, k: int) -> list[list[int]]:
    """Collinear chains of segments, each segment in one: best first, with a cost for each word of a gap in either text."""
    n = len(segs)
    if n == 1:
        return [[0]]
    begin_a, begin_b, size = segs[:, 0], segs[:, 1], segs[:, 2]
    # a successor may begin within its predecessor's last shingle
    end_a, end_b = begin_a + size - k + 1, begin_b + size - k + 1
    place = np.unique(end_a)
    rank = np.searchsorted(place, end_a)
    below = np.searchsorted(place, begin_a, "right")
    tree, score, before = Fenwick(len(place)), [0.0] * n, [-1] * n
    waiting = np.argsort(end_b, kind="stable").tolist()
    w = 0
    for j in range(n):  # in order of begin_b
        while w < n and end_b[waiting[w]] <= begin_b[j]:
            i = waiting[w]
            tree.put(int(rank[i]), (score[i] + GAP_COST * float(end_a[i] + end_b[i]), i))
            w += 1
        best, i = tree.upto(int(below[j]))
        best -= GAP_COST * float(begin_a[j] + begin_b[j])
        score[j] = float(size[j]) + max(0.0, best)
        before[j] = i if best > 0 else -1
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda j: -score[j]):
        own = []
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(j)
            j = before[j]
        if own:
            out.append(own[::-1])
    return out


def _chains(k: int, least: int, window: int):
    """Rows (a, b, pa, pb, words), all of a pair together -> rows (a, va, b, vb, begin_a, end_a, begin_b, end_b, segments)."""
    shortest = max(k, (least - 2 * (window - 1)) // 2)
    names = ["a", "va", "b", "vb", "begin_a", "end_a", "begin_b", "end_b", "segments"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [("segments", pa.list_(pa.int64()))])

    def flush(keys, first, x, y, words):
        """Chains of whole pairs, which begin at `first`."""
        pair, segs = merged(np.repeat(np.arange(len(first)), np.diff(first, append=len(x))), x, y, words, k)
        lo = np.flatnonzero(np.diff(pair, prepend=-1))
        hi = np.append(lo[1:], len(pair))
        # no chain is longer than what all segments of its pair span
        reach = np.maximum.reduceat(segs[:, :2] + segs[:, 2:], lo) - np.minimum.reduceat(segs[:, :2], lo)
        rows = []
        for i in np.flatnonzero((reach >= shortest).any(1)).tolist():
            own = segs[lo[i] : hi[i]]
            for c in chain(own, k):
                some = own[c]
                end_a, end_b = int(some[-1, 0] + some[-1, 2]), int(some[-1, 1] + some[-1, 2])
                if end_b - some[0, 1] >= shortest or end_a - some[0, 0] >= shortest:
                    rows.append((*(int(c[first[i]]) for c in keys), int(some[0, 0]), end_a, int(some[0, 1]), end_b, some.ravel().tolist()))
        for at in range(0, len(rows), 5000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000], strict=True), schema.types, strict=True)], names)

    def run(batches):
        parts, size, enough = [], 0, MATCHES
        for last, batch in _with_last(batches):
            if batch is not None:
                parts.append([column(batch, n).to_numpy().astype(np.int64) for n in ("a", "b", "pa", "pb", "words")])
                size += batch.num_rows
            if not size or (size < enough and not last):
                continue
            a, b, x, y, words = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys = (a, x >> 32, b, y >> 32)
            first = np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], 0)) + 1))
            stop = size if last else int(first[-1])  # the last pair may go on in the next batch
            if stop:
                yield from flush([c[:stop] for c in keys], first if last else first[:-1], x[:stop] & 0xFFFFFFFF, y[:stop] & 0xFFFFFFFF, words[:stop])
            parts, size = [[c[stop:].copy() for c in (a, b, x, y, words)]], size - stop
            enough = max(MATCHES, 2 * size)

    return run


def _with_last(batches):
    """(False, batch) for each batch, and (True, None) after them."""
    for batch in batches:
        yield False, batch
    yield True, None


def _slices(batches):
    """Rows (text, asked: [(chain, second, lo, hi)]) -> rows (chain, second, lo, words): word hashes of the asked ranges, cut at the text's ends.

    Results leave in batches of a few megabytes, however many requests a text has.
    """

    def made(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["chain", "second", "lo", "words"])

    for batch in batches:
        asked = column(batch, "asked")
        bounds = np.asarray(asked.offsets).astype(np.int64)
        each = asked.values
        chain, second, begin, end = (each.field(each.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("chain", "second", "lo", "hi"))
        data, offsets = text_buffers(column(batch, "text"))
        for lo, hi in chunks(offsets):
            offs = offsets[lo : hi + 1] - offsets[lo]
            _, _, hashes, first = WHITE_WORDS(data[offsets[lo] : offsets[hi]], offs)
            rows, size = [], 0
            for i in range(lo, hi):
                own = hashes[first[i - lo] : first[i - lo + 1]]
                for x in range(bounds[i], bounds[i + 1]):
                    at = max(0, int(begin[x]))
                    rows.append((int(chain[x]), bool(second[x]), at, own[at : int(end[x])].tobytes()))
                    size += len(rows[-1][3]) + 64
                    if size > 1 << 23:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each begin of y: how many words x and y from there have in common, in order. One row at a time."""
    row = np.zeros(len(y) + 1, np.int64)
    for w in x[::-1]:
        row[:-1] = np.maximum(row[:-1], row[1:] + (y == w))
        row = np.maximum.accumulate(row[::-1])[::-1]
    return row


def align_gap(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Global alignment of two word runs with the most equal columns -> columns (in x or -1, in y or -1, equal)."""
    n, m = len(x), len(y)
    if not n or not m:
        return [(i, -1, 0) for i in range(n)] + [(-1, j, 0) for j in range(m)]
    if n * m > CELLS and n > 1:  # halved where both parts have most in common, so that memory stays that of one row
        half = n // 2
        split = int(np.argmax(_common(x[:half][::-1], y[::-1])[::-1] + _common(x[half:], y)))
        rest = align_gap(x[half:], y[split:])
        return align_gap(x[:half], y[:split]) + [(i + half if i >= 0 else -1, j + split if j >= 0 else -1, e) for i, j, e in rest]
    if n == 1:
        own = np.flatnonzero(y == x[0])
        at = int(own[0]) if len(own) else 0
        return [(-1, j, 0) for j in range(at)] + [(0, at, int(len(own) > 0))] + [(-1, j, 0) for j in range(at + 1, m)]
    equal = (x[:, None] == y[None, :]).tolist()
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, under, eq = table[i], table[i + 1], equal[i]
        for j in range(m - 1, -1, -1):
            row[j] = under[j + 1] + 1 if eq[j] else max(under[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if equal[i][j]:
            out.append((i, j, 1))
            i, j = i + 1, j + 1
        elif table[i + 1][j + 1] == table[i][j]:
            out.append((i, j, 0))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            out.append((i, -1, 0))
            i += 1
        else:
            out.append((-1, j, 0))
            j += 1
    return out + [(i, -1, 0) for i in range(i, n)] + [(-1, j, 0) for j in range(j, m)]


def align(x: np.ndarray, y: np.ndarray, segs: list[tuple[int, int, int]]) -> np.ndarray:
    """Alignment columns (in x or -1, in y or -1, equal) of two word runs along chained segments, and beyond their ends."""
    parts = []

    def diagonal(i: int, j: int, n: int) -> None:
        n = min(n, len(x) - i, len(y) - j)
        if n > 0:
            parts.append(np.stack((np.arange(i, i + n), np.arange(j, j + n), (x[i : i + n] == y[j : j + n]).astype(np.int64)), 1))

    i, j = segs[0][:2]
    n = min(i, j)
    diagonal(i - n, j - n, n)
    for a, b, size in segs:
        over = max(0, i - a, j - b)  # words that the last segment has taken
        a, b, size = a + over, b + over, size - over
        if size <= 0:
            continue
        if a > i or b > j:
            gap = np.array(align_gap(x[i:a], y[j:b]), np.int64).reshape(-1, 3)
            gap[:, 0] += np.where(gap[:, 0] >= 0, i, 0)
            gap[:, 1] += np.where(gap[:, 1] >= 0, j, 0)
            parts.append(gap)
        diagonal(a, b, size)
        i, j = a + size, b + size
    diagonal(i, j, min(len(x) - i, len(y) - j))
    return np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)


def stretches(columns: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Disjoint column ranges with `share` of equal columns and `least` words in both runs, by maximal scoring ranges."""
    # equal columns gain 1 - share, others lose share: a maximal range has `share` of equal ones, and so has each of its ends
    gain = np.where(columns[:, 2] == 1, 1.0 - share, -share) + 1e-9
    equal = np.concatenate(([0], np.cumsum(columns[:, 2])))
    out, todo = [], [(0, len(gain))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least or equal[hi] - equal[lo] < fewest(least, share):
            continue
        total = np.concatenate(([0.0], np.cumsum(gain[lo:hi])))
        low = np.minimum.accumulate(total)
        end = int(np.argmax(total - low))
        if end == 0:
            continue
        begin = int(np.flatnonzero(total[: end + 1] == low[end])[0])
        b, e = lo + begin, lo + end
        if ((columns[b:e, 0] >= 0).sum() >= least) and ((columns[b:e, 1] >= 0).sum() >= least):
            out.append((b, e))
        todo += [(lo, b), (e, hi)]
    return sorted(out)


def fewest(least: int, share: float) -> float:
    """Equal columns that a range needs for a stretch in it."""
    return (share - 1e-9) * least - 1e-6


def plain_stretches(equal: np.ndarray, first: np.ndarray, least: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """stretches of many alignments without gaps, whose columns from first[i] to first[i + 1] are in `equal` -> (alignment, begin, end)."""
    gain = np.where(equal, 1.0 - share, -share) + 1e-9
    hits = np.concatenate(([0], np.cumsum(equal)))
    row, lo, hi = np.arange(len(first) - 1), first[:-1], first[1:]
    out = []
    while True:
        some = (hi - lo >= least) & (hits[hi] - hits[lo] >= fewest(least, share))
        order = np.argsort(lo[some] - hi[some], kind="stable")  # longest first: rows of a table have about one length
        row, lo, hi = row[some][order], lo[some][order], hi[some][order]
        if not len(row):
            break
        begin, end, at = np.empty_like(lo), np.empty_like(lo), 0
        while at < len(row):
            width = int(hi[at] - lo[at])
            to = at + max(1, COLUMNS // width)
            place = lo[at:to, None] + np.arange(width)
            inside = place < hi[at:to, None]
            total = np.zeros((len(place), width + 1))
            np.cumsum(np.where(inside, gain[np.where(inside, place, 0)], -1.0), axis=1, out=total[:, 1:])
            low = np.minimum.accumulate(total, axis=1)
            stop = np.argmax(total - low, axis=1)
            begin[at:to] = lo[at:to] + np.argmax(total == low[np.arange(len(low)), stop][:, None], axis=1)
            end[at:to] = lo[at:to] + stop
            at = to
        found = end - begin >= least
        out.append(np.stack((row[found], begin[found], end[found])))
        more = end > begin
        row, lo, hi = np.tile(row[more], 2), np.concatenate((lo[more], end[more])), np.concatenate((begin[more], hi[more]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def _word_runs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the n + 1 offsets into them."""
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint64), (offs - offs[0]) // 8


ALIGNED = ["chain", "a", "va", "begin_a", "end_a", "b", "vb", "begin_b", "end_b", "n_equal", "n_columns"]


def _aligned_plain(batch: pa.RecordBatch, least: int, share: float, margin: int):
    """_aligned for chains of one segment: their alignments are diagonals, so all are worked on together."""
    get = lambda n: column(batch, n).to_numpy(zero_copy_only=False).astype(np.int64)
    segs = column(batch, "segments")
    at = np.asarray(segs.offsets)[:-1].astype(np.int64)
    begins = np.asarray(segs.values)
    la, lb = get("lo_a"), get("lo_b")
    (x, first_x), (y, first_y) = (_word_runs(column(batch, n)) for n in ("words_a", "words_b"))
    nx, ny = np.diff(first_x), np.diff(first_y)
    i, j = begins[at] - la, begins[at + 1] - lb
    i, j = i - np.minimum(i, j), j - np.minimum(i, j)
    size = np.minimum(nx - i, ny - j)
    before = (la > 0) & (lb > 0)
    after = (nx == get("end_a") + margin - la) & (ny == get("end_b") + margin - lb)
    whole = np.concatenate(([0], np.cumsum(size)))
    for lo, hi in chunks(whole, COLUMNS):
        first = whole[lo : hi + 1] - whole[lo]
        nth = np.arange(first[-1])
        equal = x[np.repeat(first_x[lo:hi] + i[lo:hi] - first[:-1], size[lo:hi]) + nth] == y[np.repeat(first_y[lo:hi] + j[lo:hi] - first[:-1], size[lo:hi]) + nth]
        row, begin, end = plain_stretches(equal, first, least, share)
        hits = np.concatenate(([0], np.cumsum(equal)))
        on = np.zeros(hi - lo, bool)
        on[row[((begin == first[row]) & before[lo + row]) | ((end == first[row + 1]) & after[lo + row])]] = True
        own = lo + row
        of_a, of_b = i[own] + la[own] - first[row], j[own] + lb[own] - first[row]
        some = batch.select(["chain", "a", "va", "b", "vb"]).take(pa.array(own))
        cols = [column(some, n) for n in ("chain", "a", "va")] + [begin + of_a, end + of_a] + [column(some, n) for n in ("b", "vb")] + [begin + of_b, end + of_b, hits[end] - hits[begin], end - begin]
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), pa.array(on[row], pa.bool_())], [*ALIGNED, "open"])


def _aligned(least: int, share: float, margin: int):
    """Rows of chains with their words -> rows of passages, and whether a chain's alignment goes on past the words it was given."""

    def gapped(batch):
        rows, opens = [], []
        get = lambda n: column(batch, n).to_pylist()
        for key, a, va, b, vb, end_a, end_b, segs, la, wa, lb, wb in zip(*map(get, ("chain", "a", "va", "b", "vb", "end_a", "end_b", "segments", "lo_a", "words_a", "lo_b", "words_b")), strict=True):
            x, y = np.frombuffer(wa, np.uint64), np.frombuffer(wb, np.uint64)
            cols = align(x, y, [(segs[i] - la, segs[i + 1] - lb, segs[i + 2]) for i in range(0, len(segs), 3)])
            found = stretches(cols, least, share)
            # words before the first and after the last column that both texts have and that were not asked for
            before = la > 0 and lb > 0
            after = len(x) == end_a + margin - la and len(y) == end_b + margin - lb
            on = any((lo == 0 and before) or (hi == len(cols) and after) for lo, hi in found)
            for lo, hi in found:
                some = cols[lo:hi]
                ia, ib = some[some[:, 0] >= 0, 0], some[some[:, 1] >= 0, 1]
                rows.append((key, a, va, int(ia[0]) + la, int(ia[-1]) + la + 1, b, vb, int(ib[0]) + lb, int(ib[-1]) + lb + 1, int(some[:, 2].sum()), hi - lo))
                opens.append(on)
        return pa.record_batch([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(ALIGNED))), pa.array(opens, pa.bool_())], [*ALIGNED, "open"])

    def run(batches):
        for batch in batches:
            plain = pa.array(np.diff(np.asarray(column(batch, "segments").offsets)) == 3)
            yield from _aligned_plain(batch.filter(plain), least, share, margin)
            yield gapped(batch.filter(pc.invert(plain)))

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and variant of rows with both, and whether ids repeat: if so variant is a hash of the text, else 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return docs.withColumn("variant", _variant(F.col("text"), repeated)), repeated


def _variant(text: Column, repeated: bool) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)) if repeated else F.lit(0).cast("long")


def _passages(docs: DataFrame, least: int, k: int, share: float, window: int) -> tuple[DataFrame, bool]:
    """repeated_passages with the variants va and vb of both rows, and whether ids repeat."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    docs, repeated = _keyed(docs)
    least_often = max(50, FREQUENT * docs.count() / 2)
    # runs of `least` equal words, of which every document with one meets the first: an anchor is in each picked window
    size = least - NEAR + 1
    long = size // 2 + 1
    bits, anchors_often, seeds_often = maps(docs.mapInArrow(lean(_counted(k, window, long, size - long + 1)), COUNTED), least_often, scratch)
    seeds = k, window, spark.sparkContext.broadcast(seeds_often.tobytes())
    picks = long, size - long + 1, size, spark.sparkContext.broadcast([bits.tobytes(), anchors_often.tobytes()])
    scratch.free_shuffles()
    # one generator for both partners: each seed meets its first document, and its last unless that pair is known
    pair = lambda a, b, pa_, pb: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(pa_).alias("pa"), F.col(pb).alias("pb"))
    text = lambda at: F.shiftright(at, 32)
    differ = lambda x, y: (F.col("doc") != F.col(x)) | (text("at") != text(y))
    both = F.array(F.when(differ("first", "at_first"), pair("first", "doc", "at_first", "at")), F.when(differ("last", "at_last") & differ("first", "at_first"), pair("doc", "last", "at", "at_last")))

    def matched(rows: DataFrame, spread: bool) -> DataFrame:
        group = {"f": F.min(F.struct("doc", "at")), "l": F.max(F.struct("doc", text("at").alias("text"), (-F.col("at")).alias("back")))}
        met = _led(rows, group, (F.col("f.doc") != F.col("l.doc")) | (text("f.at") != F.col("l.text")), spread)
        met = met.select("doc", "at", F.col("f.doc").alias("first"), F.col("f.at").alias("at_first"), F.col("l.doc").alias("last"), (-F.col("l.back")).alias("at_last"))
        return met.select(F.explode(both).alias("m")).where("m is not null").select("m.*")

    # what is frequent may have a share of all documents, so it goes a way of its own
    frequent = scratch.write(docs.mapInArrow(lean(_frequent(seeds, picks)), BOTH), "frequent")
    rest = docs.mapInArrow(lean(_windows(*picks)), PICKED)
    near = scratch.write(_met(rest.repartition("key"), False).unionAll(_met(frequent.where("not seed").drop("seed"), True)), "met")
    scratch.free_shuffles()
    rest = docs.mapInArrow(lean(_seeds(*seeds)), SEEDS)
    matches = matched(rest.repartition("key"), False).unionAll(matched(frequent.where("seed").select("key", "doc", "at"), True)).withColumn("words", F.lit(k))
    beside_ = near.where("key is not null").select("key", F.col("b").alias("doc"), F.col("pb").alias("at"))
    lead = beside_.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("f"), F.max(F.struct("doc", text("at").alias("text"))).alias("last"))
    lead = lead.where((F.col("f.doc") != F.col("last.doc")) | (text("f.at") != F.col("last.text"))).select("key", F.col("f.doc").alias("a"), F.col("f.at").alias("pa"))
    met = beside_.join(lead.hint("merge"), "key").where((F.col("doc") != F.col("a")) | (text("at") != text("pa"))).select("a", F.col("doc").alias("b"), "pa", F.col("at").alias("pb"), F.lit(least).alias("words"))
    met = met.unionAll(near.where("key is null").select("a", "b", "pa", "pb", F.lit(size).alias("words")))
    matches = matches.unionAll(met)
    grouped = matches.repartition("a", "b").sortWithinPartitions("a", "b", *([text("pa"), text("pb")] if repeated else []))
    found = grouped.mapInArrow(lean(_chains(k, least, window)), "a long, va long, b long, vb long, begin_a long, end_a long, begin_b long, end_b long, segments array<long>")
    chains = scratch.write(found.withColumn("chain", F.xxhash64("a", "va", "b", "vb", "begin_a", "end_a", "begin_b", "end_b")), "chains-0")
    scratch.free_shuffles()

    names = ("a", "va", "begin_a", "end_a", "b", "vb", "begin_b", "end_b", "n_equal", "n_columns")
    margin, parts = MARGIN, []
    while True:
        n = len(parts)
        full = _worded(docs, chains, margin, scratch, n, repeated)
        made = scratch.write(full.mapInArrow(lean(_aligned(least, share, margin)), ", ".join(f"{c} long" for c in ("chain", *names)) + ", open boolean"), f"passages-{n}")
        parts.append(made.where("not open").select(*names))
        scratch.drop(f"words-{n}", f"often-{n}")
        scratch.free_shuffles()
        on = made.where("open").select("chain").distinct()
        if not on.limit(1).count():
            break
        chains = scratch.write(chains.join(on, "chain", "left_semi"), f"chains-{n + 1}")  # once more, with more words
        margin *= GROWTH
    scratch.drop("frequent", "met", *(f"chains-{n}" for n in range(len(parts))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out, repeated


def _worded(docs: DataFrame, chains: DataFrame, margin: int, scratch: Scratch, nth: int, repeated: bool) -> DataFrame:
    """chains with the word hashes of both texts from `margin` words before to `margin` words after the chain."""
    asks = []
    for side in "ab":
        ask = F.struct("chain", F.lit(side == "b").alias("second"), (F.col(f"begin_{side}") - margin).alias("lo"), (F.col(f"end_{side}") + margin).alias("hi"))
        asks.append(chains.select(F.col(side).alias("doc_id"), F.col(f"v{side}").alias("variant"), ask.alias("ask")))
    asks = asks[0].unionAll(asks[1])
    # a document that very many ask for gets several rows, each with a bounded number of requests
    often = scratch.write(asks.groupBy("doc_id", "variant").count(), f"often-{nth}")
    asks = asks.join(often, ["doc_id", "variant"]).withColumn("salt", F.pmod(F.col("ask.chain"), F.ceil(F.col("count") / TOGETHER)))
    # dealt anew, or the join's partitions by doc_id would serve and one task get all requests for a document
    keys = ["doc_id", "variant", "salt"]
    asks = asks.repartition(*keys).groupBy(*keys).agg(F.collect_list("ask").alias("asked"))
    words = docs.join(asks, ["doc_id", "variant"]).select("text", "asked").mapInArrow(lean(_slices), "chain long, second boolean, lo long, words binary")
    words = scratch.write(words.dropDuplicates(["chain", "second"]) if repeated else words, f"words-{nth}")  # equal rows answer alike
    full = chains
    for side in "ab":
        full = full.join(words.where(F.col("second") == (side == "b")).select("chain", F.col("lo").alias(f"lo_{side}"), F.col("words").alias(f"words_{side}")), "chain")
    scratch.free_shuffles()
    return full


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 5, share: float = 0.8, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> passages that two documents share: a, begin_a, end_a, b, begin_b, end_b, n_equal, n_columns.

    a <= b are doc_ids, begin and end count words (white space parts them, ASCII case is ignored), n_equal of the
    alignment's n_columns columns are equal words. A document with a passage that others share is reported with at least
    one of them: always where `least` words in a row are equal, as each such window is compared with the first document
    that has it. Of passages with differing words: if k + window - 1 words in a row are equal somewhere, and a document
    with the whole passage is the first or the last to have some stretch of it (about a third of `least`); the alignment then
    goes on as far as the passage does. Rows with the same doc_id and different texts are documents of their own (a = b where
    they share a passage); rows with the same doc_id and text are one. Passages within one document, rows without a doc_id,
    and null, empty or shorter texts have none. Other columns are ignored.
    """
    return _passages(docs, least, k, share, window)[0].drop("va", "vb")


def _cut(batches):
    for batch in batches:
        texts, spans, out = column(batch, "text"), column(batch, "spans").to_pylist(), []
        data, offsets = text_buffers(texts)
        for lo, hi in chunks(offsets):
            offs = offsets[lo : hi + 1] - offsets[lo]
            raw = data[offsets[lo] : offsets[hi]]
            starts, _, _, first = WHITE_WORDS(raw, offs)
            raw = raw.tobytes()
            for i in range(lo, hi):
                at, end, kept = int(offs[i - lo]), int(offs[i - lo + 1]), []
                own = starts[first[i - lo] : first[i - lo + 1]].tolist()
                for s in sorted(spans[i] or [], key=lambda s: s["begin"]):
                    b, e = own[s["begin"]], own[s["end"]] if s["end"] < len(own) else end
                    if b > at:
                        kept.append(raw[at:b])
                    at = max(at, e)
                kept.append(raw[at:end])
                out.append(b"".join(kept).decode("utf-8", "replace") if texts[i].is_valid else None)
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        yield pa.record_batch([*(column(batch, n) for n in names), pa.array(out, pa.string())], [*names, "text"])


def cut_repeats(docs: DataFrame, least: int = 50, k: int = 5, share: float = 0.8, window: int = WINDOW) -> DataFrame:
    """docs with each repeated passage cut from all documents but the first that has it; columns and other rows stay.

    `n_chars`, where there is such a column, follows the text. A document of which no word is left goes.
    """
    passages, repeated = _passages(docs, least, k, share, window)
    spans = passages.select(F.col("b").alias("__doc"), F.col("vb").alias("__text"), F.struct(F.col("begin_b").alias("begin"), F.col("end_b").alias("end")).alias("s")).distinct()
    spans = spans.groupBy("__doc", "__text").agg(F.collect_list("s").alias("spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    rest = docs.toDF(*names)
    kinds = dict(rest.dtypes)
    own = _variant(rest[place["text"]].cast("string"), repeated)
    joined = rest.join(spans, (rest[place["doc_id"]].cast("long") == spans["__doc"]) & (own == spans["__text"]), "left")
    keep = [n for n in names if n != place["text"]]
    plain = joined.where("spans is null").select(*names)
    cut = joined.where("spans is not null").select(*keep, F.col(place["text"]).alias("text"), "spans")
    cut = cut.mapInArrow(lean(_cut), ", ".join(f"{n} {kinds[n]}" for n in keep) + ", text string")
    cut = cut.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in place:
        cut = cut.withColumn(place["n_chars"], F.length("text").cast(kinds[place["n_chars"]]))
    return plain.unionByName(cut.withColumnRenamed("text", place["text"])).toDF(*docs.columns)
