"""How filters interact: a packed bitmap index of what each filter fails, and exact counts for every order of the filters.

Each partition packs its rows into bitmaps, a chunk at a time: one for each filter, one for each label, and one run of whole
bytes for each part, so that a part's rows are a range of every bitmap. `subset_counts` takes what every subset of the filters
keeps by AND-NOT and counts bits; only these sums, 2 ** filters for each part, are shuffled. Whatever stands before a step of an
order is such a subset, so all orders, redundancies, sole failures and Shapley sums come from them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, lean

FILTERS = "ABCDE"
LABELS = ("quality", "toxic")
#: Rows of a chunk; its bitmaps take an eighth of that, a part's run ends at a whole byte.
CHUNK = 1 << 16
#: Rows of the index that are counted at once.
RUNS = 128
#: Parts whose orders are written out at once.
PARTS = 64
WHITE = " \t\n\x0b\x0c\r"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters that look at it alone: few words, repeated words, capitals, symbols."""
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _first_holders(rows: DataFrame) -> DataFrame:
    """key, doc_id: the least doc_id that has each text. Copies meet in partial sums, so a group of any size is no burden."""
    return rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


def failing(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text, source), labels (doc_id, quality, toxic) -> part, A to E, quality, toxic: one row for each row of docs.

    A null text is empty, a null source the empty string. E holds for texts that a smaller doc_id has as well; rows without a
    doc_id neither have nor are a smaller one, and have no labels. An id labelled twice has a label that any of its rows gives.
    Texts are compared by sha256. Rows are joined by doc_id, never by text, so copies do not meet in a partition.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), *(c.alias(name) for name, c in failures(F.col("text")).items()))
    rows = scratch.write(rows, "rows")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in LABELS))
    known = rows.where("doc_id is not null")
    known = known.join(_first_holders(rows).withColumn("first", F.lit(True)), ["doc_id", "key"], "left").join(marks, "doc_id", "left")
    known = known.select("part", *FILTERS[:4], F.col("first").isNull().alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in LABELS))
    none = rows.where("doc_id is null").select("part", *FILTERS[:4], *(F.lit(False).alias(c) for c in ("E", *LABELS)))
    return known.unionAll(none)


def bitmap_index(rows: DataFrame, flags: list[str], part: str = "part") -> DataFrame:
    """rows (part string, boolean flags) -> part, n, one bitmap for each flag: a row for each chunk of rows and part in it.

    Bit i of a bitmap, from the highest of the first byte on, is row i of n. Chunks are cut within partitions, without a
    shuffle. Null flags count as false.
    """
    schema = pa.schema([(part, pa.string()), ("n", pa.int64()), *((f, pa.binary()) for f in flags)])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = column(batch, part).dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        present, first, sizes = np.unique(codes[order], return_index=True, return_counts=True)
        width = -(-sizes // 8)  # bytes of each part's run
        at = np.concatenate(([0], np.cumsum(width)))
        place = np.arange(len(order)) + np.repeat(8 * at[:-1] - first, sizes)
        out = [names.dictionary.take(pa.array(present)), pa.array(sizes)]
        for f in flags:
            bits = np.zeros(8 * at[-1], bool)
            bits[place] = column(batch, f).fill_null(False).to_numpy(zero_copy_only=False)[order]
            out.append(pa.Array.from_buffers(pa.binary(), len(present), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.packbits(bits))]))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(lo, CHUNK))
                n += held[-1].num_rows
                if n >= CHUNK:
                    yield pack(pa.concat_batches(held))
                    held, n = [], 0
        if n:
            yield pack(pa.concat_batches(held))

    flag = [F.col(f).cast("boolean").alias(f) for f in flags]
    return rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias(part), *flag).mapInArrow(lean(run), f"`{part}` string, n long, " + ", ".join(f"`{f}` binary" for f in flags))


def subset_counts(index: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """part, subset (bit i: filter i is in it), n and n of each label: rows that no filter of the subset fails, and those labelled.

    kept(subset) is kept(subset without its lowest filter) AND-NOT that filter's bitmap; bytes are counted and summed over each
    row of the index, then over partitions.
    """
    counted = ["n", *(f"n_{c}" for c in labels)]

    def bitmap(batch: pa.RecordBatch, name: str) -> np.ndarray:
        c = column(batch, name)
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        return np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]]

    def sliced(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, RUNS):
                yield batch.slice(lo, RUNS)

    def run(batches):
        for batch in sliced(batches):
            n = column(batch, "n").to_numpy()
            width = -(-n // 8)
            starts = np.cumsum(width) - width
            every = np.full(int(width.sum()), 255, np.uint8)
            every[starts + width - 1] = (255 << (8 * width - n) & 255).astype(np.uint8)  # no bits beyond the last row
            failed, marks = [bitmap(batch, f) for f in filters], [bitmap(batch, c) for c in labels]
            kept, out = {0: every}, {name: [] for name in counted}
            for subset in range(1 << len(filters)):
                if subset:
                    low = subset & -subset
                    kept[subset] = kept[subset ^ low] & ~failed[low.bit_length() - 1]
                for name, mark in zip(counted, [None, *marks], strict=True):
                    seen = kept[subset] if mark is None else kept[subset] & mark
                    out[name].append(np.add.reduceat(np.bitwise_count(seen).astype(np.int64), starts))
            subsets = np.repeat(np.arange(1 << len(filters), dtype=np.int32), len(n))
            names = column(batch, part).take(pa.array(np.tile(np.arange(len(n)), 1 << len(filters))))
            yield pa.RecordBatch.from_arrays([names, pa.array(subsets), *(pa.array(np.concatenate(out[x])) for x in counted)], names=[part, "subset", *counted])

    rows = index.mapInArrow(lean(run), f"`{part}` string, subset int, " + ", ".join(f"{x} long" for x in counted))
    return rows.groupBy(part, "subset").agg(*(F.sum(x).alias(x) for x in counted))


def order_report(counts: DataFrame, filters: str, labels: list[str], part: str = "part") -> DataFrame:
    """subset_counts -> part, filter_order, step, kept, removed, redundant, unique_fails, lost_<label>, shapley: a row for each part, order and step.

    shapley sums over all orders what the step's filter removes: it stands after the same set of others in |set|! times
    (filters - 1 - |set|)! of them.
    """
    size, counted = len(filters), ["n", *(f"n_{c}" for c in labels)]
    orders = ["".join(p) for p in permutations(filters)]
    which = np.array([[filters.index(f) for f in order] for order in orders])
    after = np.cumsum(1 << which, axis=1).ravel()
    which, steps = which.ravel(), np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders))
    bit, whole = 1 << which, (1 << size) - 1
    before = after - bit
    named = pa.array(np.repeat(orders, size))
    subsets = np.arange(1 << size)
    weights = np.array([factorial(b.bit_count()) * factorial(max(size - 1 - b.bit_count(), 0)) for b in subsets.tolist()])

    def run(batches):
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, PARTS):
                batch = whole_batch.slice(lo, PARTS)
                k = {x: np.array(column(batch, x).to_pylist(), np.int64) for x in counted}
                n = k["n"]
                shapley = np.stack([((n[:, s] - n[:, s | 1 << i]) * weights[s]).sum(1) for i in range(size) for s in [subsets[subsets & 1 << i == 0]]], 1)
                removed = n[:, before] - n[:, after]
                fails = n[:, :1] - n[:, bit]
                out = [n[:, after], removed, fails - removed, n[:, whole ^ bit] - n[:, [whole]], *(k[x][:, before] - k[x][:, after] for x in counted[1:]), shapley[:, which]]
                rows = np.arange(batch.num_rows)
                parts = column(batch, part).take(pa.array(np.repeat(rows, len(which))))
                arrays = [parts, pa.concat_arrays([named] * len(rows)), pa.array(np.tile(steps, len(rows))), *(pa.array(x.ravel()) for x in out)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"lost_{c}" for c in labels), "shapley"]
    schema = f"`{part}` string, filter_order string, step int, " + ", ".join(f"`{x}` long" for x in names[3:])
    wide = counts.groupBy(part).agg(*(F.array_sort(F.collect_list(F.struct("subset", x))).getField(x).alias(x) for x in counted))
    return wide.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, labels -> part (source), filter_order, step, kept, removed, redundant, unique_fails, lost_quality, lost_toxic, shapley.

    Every row of docs counts, repeated ones too; see `failing` for nulls. Without rows there are no parts. Other columns are
    ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    rows = failing(docs, labels, scratch)
    index = bitmap_index(rows, [*FILTERS, *LABELS])
    return order_report(subset_counts(index, list(FILTERS), list(LABELS)), FILTERS, list(LABELS))
