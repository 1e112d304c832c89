"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` consecutive words (a shorter item is one window). A window is the set of its
shingles with their positions; it occurs in a text only if all of them do, so by the prefix filter one shingle is enough to
find it: the rarest, by counts over all texts. Texts are joined on these prefix shingles; the length bound (the text has
enough words) and the positional bound (the shingle lies where the window still fits) discard candidates, and the rest are
verified word by word.

The items are joined in blocks of at most BLOCK_WORDS words, so what is broadcast has that bound for every benchmark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, column, lean, text_buffers
from .words import ALNUM_WORDS, U, grams

#: Words of a prefix shingle, or all of a window with fewer.
SHINGLE = 5
#: Most words of one broadcast block of items, and of one piece of an item.
BLOCK_WORDS, PIECE = 1 << 20, 1 << 12
_MASK = (1 << 20) - 1


def _words(texts: pa.Array):
    data, offsets = text_buffers(texts)
    for lo, hi in chunks(offsets):
        offs = offsets[lo : hi + 1] - offsets[lo]
        _, _, hashes, first = ALNUM_WORDS(data[offsets[lo] : offsets[hi]], offs)
        yield lo, hi, hashes, first


def pieces(window: int):
    """Arrow batches of (item_id, text) -> rows (item_id, part, n, words): an item's word hashes in overlapping pieces."""

    def run(batches):
        for batch in batches:
            ids, out = column(batch, "item_id"), []
            for lo, hi, hashes, first in _words(column(batch, "text")):
                for i in range(lo, hi):
                    own = hashes[first[i - lo] : first[i - lo + 1]]
                    for part, at in enumerate(range(0, max(1, len(own) - window + 1), PIECE)):
                        some = own[at : at + PIECE + window - 1]
                        if len(some):
                            out.append((ids[i].as_py(), part, len(some), some.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "part", "n", "words"), x, strict=True)) for x in out], schema=pa.schema([("item_id", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("words", pa.binary())]))

    return run


class Block:
    """The windows of a bounded set of items, and the shingles that can find them."""

    def __init__(self, rows: pd.DataFrame, window: int):
        rows = rows.sort_values(["item_id", "part"], na_position="last")
        self.ids = sorted({x for x in rows["item_id"] if x is not None and x == x})
        place = {x: i for i, x in enumerate(self.ids)}
        words, start, size, item, at = [], [], [], [], 0
        for name, raw in zip(rows["item_id"], rows["words"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            n = max(1, len(own) - window + 1)
            start.append(at + np.arange(n))
            size.append(np.full(n, min(window, len(own))))
            item.append(np.full(n, place.get(name, -1)))
            words.append(own)
            at += len(own)
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.words, self.start, self.size, self.item = whole(words, np.uint64), whole(start, np.int64), whole(size, np.int64), whole(item, np.int64)
        self.keys: dict[int, np.ndarray] = {}

    def shingles(self, k: int):
        """For the windows whose shingles have k words: their numbers, and the hashes of all their shingles."""
        own = np.flatnonzero(np.minimum(self.size, SHINGLE) == k)
        found = grams(self.words, k)
        for n in np.unique(self.size[own]):
            some = own[self.size[own] == n]
            yield some, found[self.start[some][:, None] + np.arange(n - k + 1)]

    def all_shingles(self) -> dict[int, np.ndarray]:
        out = {}
        for k in np.unique(np.minimum(self.size, SHINGLE)).tolist():
            out[k] = np.unique(np.concatenate([h.ravel() for _, h in self.shingles(k)]))
        return out

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle; windows with a shingle that no text has can't occur."""
        self.keys = {}
        for k in np.unique(np.minimum(self.size, SHINGLE)).tolist():
            all_keys, all_windows, all_offsets = [], [], []
            known = np.array(sorted(h for j, h in counts if j == k), np.uint64)
            if not len(known):
                continue
            often = np.array([counts[k, int(h)] for h in known.tolist()])
            for windows, hashes in self.shingles(k):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                times = np.where(known[at] == hashes, often[at], 0)
                keep = times.min(1) > 0
                offset = times.argmin(1)
                all_keys.append(hashes[np.arange(len(windows)), offset][keep])
                all_windows.append(windows[keep])
                all_offsets.append(offset[keep])
            keys, windows, offsets = np.concatenate(all_keys), np.concatenate(all_windows), np.concatenate(all_offsets)
            order = np.argsort(keys, kind="stable")
            self.keys[k] = (keys[order], windows[order], offsets[order], _filter(keys))


def _filter(keys: np.ndarray) -> np.ndarray:
    """A bitmap that no key misses and most other hashes do."""
    out = np.zeros(_MASK + 1, bool)
    out[(keys & U(_MASK)).astype(np.int64)] = True
    return out


def count_shingles(shared):
    """Arrow batches of (text) -> rows (k, hash, n): how often the benchmark's shingles occur."""

    def run(batches):
        wanted = {k: (np.frombuffer(raw, np.uint64)) for k, raw in shared.value.items()}
        maps = {k: _filter(v) for k, v in wanted.items()}
        for batch in batches:
            sums = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
            for _, _, hashes, first in _words(column(batch, "text")):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for k, keys in wanted.items():
                    g = grams(hashes, k)
                    at = np.flatnonzero(maps[k][(g & U(_MASK)).astype(np.int64)])
                    at = at[doc[at] == doc[at + k - 1]]
                    place = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
                    np.add.at(sums[k], place[keys[place] == g[at]], 1)
            for k, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array(np.full(len(some), k)), pa.array(wanted[k][some].view(np.int64)), pa.array(n[some])], ["k", "hash", "n"])

    return run


def _hits(block: Block, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covered: per word, docs, items: pairs of a text and an item with a window in it)."""
    covered, docs, items = np.zeros(len(hashes) + 1, np.int64), [], []
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, (keys, windows, offsets, bitmap) in block.keys.items():
        if not len(keys):
            continue
        g = grams(hashes, k)
        at = np.flatnonzero(bitmap[(g & U(_MASK)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
        times = hi - lo
        at, lo = np.repeat(at, times), np.repeat(lo, times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        window, begin = windows[lo + nth], at - offsets[lo + nth]
        size = block.size[window]
        fits = (begin >= first[doc[at]]) & (begin + size <= first[doc[at] + 1])  # the positional and the length bound
        window, begin, size, own = window[fits], begin[fits], size[fits], doc[at[fits]]
        same = np.ones(len(window), bool)
        for j in range(int(size.max(initial=0))):
            some = np.flatnonzero(same & (size > j))
            same[some] = hashes[begin[some] + j] == block.words[block.start[window[some]] + j]
        window, begin, size, own = window[same], begin[same], size[same], own[same]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + size, -1)
        docs.append(own)
        items.append(block.item[window])
    pair = np.unique(np.stack((np.concatenate(docs), np.concatenate(items))), axis=1) if docs else np.zeros((2, 0), np.int64)
    return np.cumsum(covered[:-1]) > 0, pair[0], pair[1]


def join_block(shared):
    """Arrow batches of (row, text) -> rows (row, n_words, begins, ends, items): runs of hit words and the items they come from."""

    def run(batches):
        block = shared.value
        for batch in batches:
            n_words, runs, items = [], [], []
            for lo, hi, hashes, first in _words(column(batch, "text")):
                n_words += np.diff(first).tolist()
                own_runs, own_items = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                covered, docs, found = _hits(block, hashes, first)
                for d, i in zip(docs.tolist(), found.tolist(), strict=True):
                    if i >= 0:
                        own_items[d].append(block.ids[i])
                for d in np.unique(docs).tolist():
                    mask = np.concatenate(([False], covered[first[d] : first[d + 1]], [False]))
                    own_runs[d] = np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2).tolist()
                runs += own_runs
                items += own_items
            out = [column(batch, name) for name in batch.schema.names if name != "text"]
            kind = pa.list_(pa.int64())
            out += [pa.array(n_words, pa.int64()), pa.array([[x[0] for x in r] for r in runs], kind), pa.array([[x[1] for x in r] for r in runs], kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch(out, [*(n for n in batch.schema.names if n != "text"), "n_words", "begins", "ends", "items"])

    return run


def blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcast blocks of the benchmark, each with its windows' rarest shingles over all docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "items")
    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = scratch.write(cut.mapInArrow(lean(pieces(window)), "item_id string, part long, n long, words binary"), "pieces")
    total = cut.agg(F.sum("n")).first()[0] or 0
    count = -(-total // block_words)
    out = []
    for b in range(count):
        block = Block(cut.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(count)) == b).toPandas(), window)
        wanted = spark.sparkContext.broadcast({k: v.tobytes() for k, v in block.all_shingles().items()})
        seen = docs.select("text").where("text is not null").mapInArrow(lean(count_shingles(wanted)), "k long, hash long, n long").groupBy("k", "hash").agg(F.sum("n").alias("n")).toPandas()
        block.choose({(int(k), int(h) & (1 << 64) - 1): int(n) for k, h, n in seen.itertuples(index=False)})
        out.append(spark.sparkContext.broadcast(block))
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, begins, ends, items.

    `begins` and `ends` are word ranges [begin, end) covered by occurrences of item windows, `items` the ids (as strings,
    distinct, sorted) of items with an occurring window. One row for each row of docs, with repeated rows and null ids
    kept. Null and empty texts have no words, hits or items; items without words have no windows; an item whose id is null
    hits but is not listed. Other columns are ignored. An empty benchmark hits nothing.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    key = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {key}, n_words long, begins array<long>, ends array<long>, items array<string>"
    found = blocks(docs, benchmark, window, block_words)
    if len(found) <= 1:
        shared = found[0] if found else docs.sparkSession.sparkContext.broadcast(Block(pd.DataFrame({"item_id": [], "part": [], "words": []}), window))
        out = docs.mapInArrow(lean(join_block(shared)), schema)
        return out.withColumn("items", F.array_sort("items"))
    # rows with equal ids and equal texts have equal results
    docs = docs.withColumn("h", F.sha2("text", 256))
    schema = schema.replace("n_words", "h string, n_words")
    parts = [docs.mapInArrow(lean(join_block(shared)), schema) for shared in found]
    rows = parts[0].select("doc_id", "h", "n_words")
    hit = parts[0].where("size(begins) > 0")
    for part in parts[1:]:
        hit = hit.unionAll(part.where("size(begins) > 0"))
    runs = F.flatten(F.collect_set(F.arrays_zip("begins", "ends")))
    hit = hit.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.array_sort(runs).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = hit.mapInArrow(lean(merge_runs), f"d {key}, g string, begins array<long>, ends array<long>, items array<string>")
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", "n_words", F.coalesce("begins", none).alias("begins"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merge_runs(batches):
    """Unite overlapping and touching runs that different blocks found in one text."""
    for batch in batches:
        begins, ends = [], []
        for runs in column(batch, "runs").to_pylist():
            b, e = [], []
            for r in runs:
                if e and r["begins"] <= e[-1]:
                    e[-1] = max(e[-1], r["ends"])
                else:
                    b.append(r["begins"])
                    e.append(r["ends"])
            begins.append(b)
            ends.append(e)
        kind = pa.list_(pa.int64())
        yield pa.record_batch([column(batch, "d"), column(batch, "g"), pa.array(begins, kind), pa.array(ends, kind), column(batch, "items")], ["d", "g", "begins", "ends", "items"])


def n_hit() -> F.Column:
    return F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """The rule: some word is hit, and hit words are a twentieth of all or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that the rule lets stay, all columns kept. Texts without words stay.

    The rule sees the hit words of all blocks together: the word ranges of each are carried to the next.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = blocks(docs.select(F.col("text").cast("string").alias("text")), benchmark, window, block_words)
    out = docs.toDF(*names)
    text = names[[c.lower() for c in docs.columns].index("text")]
    kept = out.schema
    carried = T.StructType([*kept, T.StructField("runs", T.ArrayType(T.LongType()))])
    for k, shared in enumerate(found):
        last = k == len(found) - 1
        out = out.mapInArrow(lean(_clean(shared, text, k == 0, last)), kept if last else carried)
    return out.toDF(*docs.columns)


def _clean(shared, text: str, begins: bool, ends: bool):
    """Rows, unless `begins` with `runs`, the [begin, end, ...) that other blocks cover -> rows with these and the block's own runs, or where it `ends` the rows that stay."""

    def run(batches):
        block = shared.value
        for batch in batches:
            keep, runs = [], []
            before = None if begins else column(batch, "runs").to_pylist()
            for lo, hi, hashes, first in _words(column(batch, text)):
                covered, _, _ = _hits(block, hashes, first)
                covered = covered.astype(bool)
                for i in range(lo, hi) if before else ():
                    own = covered[first[i - lo] : first[i - lo + 1]]
                    for b, e in zip(before[i][::2], before[i][1::2], strict=True):
                        own[b:e] = True
                if ends:
                    total = np.concatenate(([0], np.cumsum(covered)))
                    hit = total[first[1:]] - total[first[:-1]]
                    keep.append(~((hit > 0) & (20 * hit >= np.diff(first))))
                else:
                    for i in range(lo, hi):
                        own = covered[first[i - lo] : first[i - lo + 1]]
                        runs.append(np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)))
            rows = batch if begins else batch.select([n for n in batch.schema.names if n != "runs"])
            if ends:
                yield rows.filter(pa.array(np.concatenate(keep))) if keep else rows
            else:
                yield pa.record_batch([*rows.columns, pa.array(runs, pa.list_(pa.int64()))], [*rows.schema.names, "runs"])

    return run


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
