"""Hierarchical multi-length packing of token ids into training sequences.

A document's full windows of the largest tier are sequences of their own. What remains goes to the smallest tier that can
hold it. Tiers are packed from the largest down: each window takes whole pieces best-fit, then its gap is filled from
shorter tiers, the last of these pieces cut to fit. So every window is exactly as long as its tier, a power of two, and
needs no padding; what is left at the end of a partition fills windows of the largest tier. Partitions pack on their own: no
shuffle, and memory is bounded by one batch of pieces. The less than one window that a partition cannot fill goes on: the
remainders of TOGETHER partitions fill windows together, then those of as many such groups, until one is left, which alone is
padded. Sequences are dealt to step groups of nearly equal numbers of tokens.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, lean
from .tokens import default_tokenizer, encoded, forget_encoders, with_end

TIERS = (256, 512, 1024, 2048)
#: Pieces packed together, and the tokens of a step group.
BATCH, STEP = 4096, 1 << 16
#: Remainders packed by one task; each is shorter than a window.
TOGETHER = 1024
NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]


class Packer:
    """Packs pieces (size, order, key); key is whatever stands for the piece's ids. `cut` is (key, taken) -> (key, key)."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)

    def route(self, size: int) -> int:
        return next(i for i, t in enumerate(self.tiers) if size <= t)

    def pack(self, pieces: list[tuple[int, int, int]], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """pieces (size, document, start) -> (sequences of such pieces, pieces left over; less than a window of them if `last`)."""
        pools: list[list] = [[] for _ in self.tiers]  # ascending by size
        for p in pieces:
            insort(pools[self.route(p[0])], p)
        out = []
        for t in range(len(self.tiers) - 1, -1, -1):
            want = self.tiers[t]
            while sum(len(p) for p in pools[: t + 1]) and (pools[t] or t == 0):
                window, room = [], want
                while room:
                    took = None
                    for pool in reversed(pools[: t + 1]):  # the largest whole piece that fits
                        at = bisect_right(pool, (room, 1 << 62, 0)) - 1
                        if at >= 0:
                            took = pool.pop(at)
                            break
                    if took is None:  # all are longer: cut the shortest
                        pool = next((p for p in pools[: t + 1] if p), None)
                        if pool is None:
                            break
                        size, doc, start = pool.pop(0)
                        took = (room, doc, start)
                        rest = (size - room, doc, start + room)
                        insort(pools[self.route(rest[0])], rest)
                    window.append(took)
                    room -= took[0]
                if room:  # short of pieces
                    return self._rest(out, window + [p for pool in pools for p in pool], last)
                out.append(window)
        return self._rest(out, [p for pool in pools for p in pool], last)

    def _rest(self, out, left, last):
        if not last:
            return out, left
        top, window, room = self.tiers[-1], [], self.tiers[-1]
        for size, doc, start in left:
            while size:
                n = min(size, room)
                window.append((n, doc, start))
                size, start, room = size - n, start + n, room - n
                if not room:
                    out.append(window)
                    window, room = [], top
        return out, window


def deal(sizes: list[int], step: int) -> list[int]:
    """The step group of each sequence: as many groups as the tokens need, each next longest to the one with the fewest."""
    groups = max(1, -(-sum(sizes) // step))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        total, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (total + sizes[i], g))
    return out


def _numbered(level: int, part: int, n: int) -> int:
    """A sequence's or step group's number: of up to 2**36 of a task."""
    return (level << 60) + (part << 36) + n


def _made(rows: list[tuple], data: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(data).astype("<u4")
    ends = 4 * np.cumsum([0, *(r[2] for r in rows)])
    cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    cols.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]))
    return pa.record_batch(cols, NAMES)


def _pack(tokenizer: str, end: int, tiers, step: int):
    """Rows (doc_id, text) -> pieces; those of a partition's remainder have the sequence_id -1 - partition."""

    def run(batches):
        packer, top = Packer(tiers), max(tiers)
        part = TaskContext.get().partitionId()
        held: dict[int, tuple] = {}  # document -> (doc_id, ids, number of ids)
        pending, whole, n, sequences, groups = [], [], 0, 0, 0

        def emit(last: bool):
            nonlocal pending, whole, held, sequences, groups
            out, left = packer.pack(pending, last)
            out, rest = whole + out, left if last else []
            sizes = [sum(p[0] for p in s) for s in out]
            dealt = deal(sizes, step)
            rows, data = [], []
            for i, s in enumerate(out):
                at = 0
                tier = tiers[packer.route(sizes[i])]
                for size, doc, start in s:
                    key, ids, total = held[doc]
                    rows.append((key, start, size, total, _numbered(0, part, sequences + i), at, tier, _numbered(0, part, groups + dealt[i])))
                    data.append(ids[start : start + size])
                    at += size
            at = 0
            for size, doc, start in rest:
                key, ids, total = held[doc]
                rows.append((key, start, size, total, -1 - part, at, top, -1))
                data.append(ids[start : start + size])
                at += size
            sequences += len(out)
            groups += max(dealt, default=-1) + 1
            pending, whole = left, []
            held = {d: held[d] for d in {p[1] for p in left}}
            return _made(rows, data) if rows else None

        waiting = 0
        for batch in batches:
            keys = column(batch, "doc_id").to_pylist()
            for lo, hi, ids, counts in encoded(tokenizer, column(batch, "text")):
                ids, counts = with_end(ids, counts, end)
                at = 0
                for key, size in zip(keys[lo:hi], counts.tolist(), strict=True):
                    held[n] = (key, ids[at : at + size], size)
                    full = size // top * top
                    whole += [[(top, n, s)] for s in range(0, full, top)]
                    if size > full:
                        pending.append((size - full, n, full))
                    at += size
                    n += 1
                    waiting += size
                if len(pending) >= BATCH or waiting >= 1 << 21:
                    waiting = 0
                    if made := emit(False):
                        yield made
        if made := emit(True):
            yield made
        forget_encoders()

    return run


def _join(level: int, top: int, step: int, last: bool):
    """Pieces of remainders, with their group, in the order of groups -> pieces in windows of `top`; each group's own remainder has
    the sequence_id -1 - group, unless it is the `last`."""

    def run(batches):
        group, windows, window, room = None, [], [], top

        def flush():
            rest = [] if last else window
            out = [w for w in [*windows, *([window] if last else [])] if w]
            dealt = deal([sum(p[2] for p in w) for w in out], step)
            rows, data = [], []
            for w, sequence, own in [*((w, _numbered(level, group, i), _numbered(level, group, g)) for i, (w, g) in enumerate(zip(out, dealt, strict=True))), (rest, -1 - group, -1)]:
                at = 0
                for key, start, size, total, ids in w:
                    rows.append((key, start, size, total, sequence, at, top, own))
                    data.append(ids)
                    at += size
            return _made(rows, data)

        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group and group is not None:
                    yield flush()
                    windows, window, room = [], [], top
                group = r["group"]
                ids, start = np.frombuffer(r["ids"], "<u4"), r["start"]
                while len(ids):
                    n = min(len(ids), room)
                    window.append((r["doc_id"], start, n, r["doc_tokens"], ids[:n]))
                    ids, start, room = ids[n:], start + n, room - n
                    if not room:
                        windows.append(window)
                        window, room = [], top
        if windows or window:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 1, tiers=TIERS, step: int = STEP) -> DataFrame:
    """docs (doc_id, text) -> one row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset,
    tier, step_group, ids (little-endian unsigned 32-bit integers).

    At most one sequence is shorter than its tier, however many partitions docs has. Null and empty texts are the end id
    alone; repeated rows and null ids are documents of their own. Other columns are ignored. An empty table packs to nothing.
    """
    scratch, tiers = Scratch(docs.sparkSession, "packing"), tuple(sorted(tiers))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} long" for c in NAMES[:-1]) + ", ids binary"
    made = scratch.write(rows.mapInArrow(lean(_pack(tokenizer or default_tokenizer(), end, tiers, step)), schema), "pieces-0")
    out, level = made.where("sequence_id >= 0"), 0
    while True:
        rest = made.where("sequence_id < 0").withColumn("group", F.floor((-1 - F.col("sequence_id")) / TOGETHER))
        most = rest.agg(F.max("group")).first()[0]
        if most is None:
            return out
        level += 1
        rest = rest.repartition("group").sortWithinPartitions("group", F.desc("sequence_id"), "offset")
        made = scratch.write(rest.mapInArrow(lean(_join(level, tiers[-1], step, most == 0)), schema), f"pieces-{level}")
        out = out.unionAll(made.where("sequence_id >= 0"))
        if most == 0:
            return out
