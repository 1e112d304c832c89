"""Token ids by a public tokenizer, and a flat binary file format for them.

A file holds one partition: `<name>.ids` is a flat array of unsigned little-endian integers (16 bits where the vocabulary
allows, else 32), `<name>.idx` a header and, per document, 64-bit offsets into that array, the 64-bit doc_ids and a byte
that says whether the doc_id is given. Both can be memory-mapped. Positions over the whole set are a partition's base, a
prefix sum of the partitions' totals, plus its own offsets.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column, lean, text_buffers
from .words import byte_hashes

MAGIC = 0x31584449544556  # "VETIDX1", little-endian
#: Pieces that the cache holds at most, and the bytes of a piece too long for it.
CACHED, LONGEST = 1_000_000, 2000
# The white space of Unicode beyond ASCII, and the characters that byte-level vocabularies write bytes with:
# printable ones of Latin-1 stand for themselves, the others in order for U+0100 and on.
_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED) if b != 0x0A}
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_made: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _odd_texts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The texts with two white-space characters in a row, or with any but blanks and line ends."""
    either = space | line
    at = [np.flatnonzero(either[1:] & either[:-1]) + 1, np.flatnonzero((data < 0x20) & ~line)]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    x = data[lead].astype(np.int64)
    y, z = (data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) for i in (1, 2))
    code = np.where(x == 0xC2, y, ((x & 15) << 12) | ((y & 63) << 6) | (z & 63))
    at.append(lead[np.isin(code, _SPACES)])
    out = np.concatenate(at)
    own = np.searchsorted(offsets, out, "right") - 1
    # two in a row count only within one text
    pair = np.arange(len(out)) < len(at[0])
    return np.unique(own[~pair | (out > offsets[own])])


class Encoder:
    """Encodes texts exactly as the tokenizer does, but each distinct piece only once while the cache holds it.

    A byte-level pre-tokenizer cuts before white space that follows anything else, around single line ends, and between an
    ASCII letter and a full stop or comma that ends a word. The ids of such pieces can be strung together. Pieces are found
    and looked up by 64-bit hashes of their bytes, for many texts at once; new ones that are letters only go straight to the
    tokenizer's model, others through all of it. Texts with other white space, or two in a row, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _encode(self, pieces: list[str]) -> tuple[list[int], np.ndarray]:
        """(ids one after the other, number of each)."""
        ids: list[list[int]] = [[]] * len(pieces)
        plain = [i for i, x in enumerate(pieces) if (x[1:] if x[:1] == " " else x).isalpha()]
        mapped = "\n".join([pieces[i] for i in plain]).encode().decode("latin-1").translate(_BYTES).split("\n") if plain else []
        for i, found in zip(plain, map(self.model.tokenize, mapped), strict=True):
            ids[i] = [t.id for t in found]
        rest = [i for i, x in enumerate(ids) if not x]
        for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return [x for own in ids for x in own], np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, sizes = self._encode(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(ids)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts and their offsets -> (ids of all texts, one after the other; number of ids of each)."""
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        if len(self.keys) > CACHED or self.used > 8 * CACHED:
            self.clear()
        space, line = data == 0x20, data == 0x0A
        odd = _odd_texts(data, offsets, space, line)
        first = np.unique(offsets[:-1][np.diff(offsets) > 0])
        start = space | line
        start[1:] |= line[:-1]
        stop = (data == 0x2E) | (data == 0x2C)
        after = np.ones(n, bool)  # white space or the end of the text follows
        after[:-1] = start[1:]
        after[first[1:] - 1] = True
        stop &= after
        stop[1:] &= _LETTERS[data[:-1]]
        stop[first] = False
        start |= stop
        start[first] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        keys = byte_hashes(data, begin, end)
        values, at, place = np.unique(keys, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
        new = self.keys[near] != values if len(self.keys) else np.ones(len(values), bool)
        if new.any():
            # a piece with a line end is the line end alone, or lies in a text that is encoded whole
            lo, hi = begin[at[new]], end[at[new]]
            sizes = hi - lo + 1
            ends = np.cumsum(sizes)
            where = np.repeat(lo - ends + sizes, sizes) + np.arange(ends[-1])
            joined = data[np.minimum(where, n - 1)]
            joined[ends - 1] = 0xFF  # never in UTF-8
            self._learn(values[new], [x.decode("utf-8", "replace") for x in joined[:-1].tobytes().split(b"\xff")])
        near = np.searchsorted(self.keys, values)
        sizes = self.size[near][place]
        ends = np.cumsum(sizes)
        out = self.flat[np.repeat(self.start[near][place] - ends + sizes, sizes) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))[np.searchsorted(begin, offsets)]
        if len(odd) or (end - begin).max() > LONGEST:
            if (end - begin).max() > LONGEST:
                self.clear()  # pieces so long are rare; they must not pile up
            parts, counts = np.split(out, upto[1:-1]), np.diff(upto)
            for i in odd.tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
                counts[i] = len(parts[i])
            return np.concatenate(parts), counts
        return out, np.diff(upto)


def forget_encoders() -> None:
    """Workers outlive their tasks: what encoders hold goes at the end of each."""
    _made.clear()


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def encoded(path: str, texts: pa.Array, most: int = 1 << 20):
    """Yields (lo, hi, ids, counts) for runs of rows with at most `most` bytes or one longer text."""
    encode = encoder(path)
    data, offsets = text_buffers(texts)
    for lo, hi in chunks(offsets, most):
        yield lo, hi, *encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each document."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one partition's files; they get their final names only when whole, and are named by attempt."""

    def __init__(self, uri: str, dtype: np.dtype):
        self.fs, self.folder = _store(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.folder}/.{self.name}.ids")
        self.dtype, self.counts, self.keys = dtype, [], []

    def add(self, ids: np.ndarray, counts: np.ndarray, keys: list) -> None:
        self.out.write(np.ascontiguousarray(ids, self.dtype).tobytes())
        self.counts.append(counts)
        self.keys += keys

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        counts = np.concatenate([np.zeros(1, np.int64), *self.counts])
        offsets = np.cumsum(counts).astype("<i8")
        given = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        with self.fs.open_output_stream(f"{self.folder}/.{self.name}.idx") as out:
            out.write(np.array([MAGIC, self.dtype.itemsize, len(keys)], "<i8").tobytes())
            for x in (offsets, keys, given):
                out.write(x.tobytes())
        for kind in ("ids", "idx"):
            self.fs.move(f"{self.folder}/.{self.name}.{kind}", f"{self.folder}/{self.name}.{kind}")
        return self.name, len(keys), int(offsets[-1])


def _mapped(fs, path: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class Reader:
    """Random access to the documents of one partition's files."""

    def __init__(self, uri: str, name: str):
        fs, folder = _store(uri)
        index = _mapped(fs, f"{folder}/{name}.idx")
        magic, width, n = index[:24].view("<i8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{uri}/{name}.idx is not an index file")
        self.offsets = index[24 : 24 + 8 * (n + 1)].view("<i8")
        self.keys = index[24 + 8 * (n + 1) : 24 + 8 * (2 * n + 1)].view("<i8")
        self.given = index[24 + 8 * (2 * n + 1) :].astype(bool)
        self.ids = _mapped(fs, f"{folder}/{name}.ids").view({2: "<u2", 4: "<u4"}[width])

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def _write(uri: str, tokenizer: str, end: int):
    def run(batches):
        writer = None
        for batch in batches:
            keys = column(batch, "doc_id").to_pylist()
            for lo, hi, ids, counts in encoded(tokenizer, column(batch, "text")):
                writer = writer or Writer(uri, encoder(tokenizer).dtype)
                writer.add(*with_end(ids, counts, end), keys[lo:hi])
        forget_encoders()
        if writer:
            name, docs, tokens = writer.close()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([docs]), pa.array([tokens])], ["part", "name", "docs", "tokens"])

    return run


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end: int) -> list[tuple[str, int, int, int]]:
    """docs (doc_id, text) to files in the shared folder uri, in ascending doc_id order (null ids last, equal ids by text).

    Returns the manifest: (file name, documents, tokens, base) of each partition in order. A null or empty text has the
    end id alone. Files that a lost attempt leaves behind are not in the manifest. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange(order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    made = rows.mapInArrow(lean(_write(uri, tokenizer, end)), "part long, name string, docs long, tokens long")
    made = Scratch(spark, "manifest").write(made, "parts")  # once written, the files' names are settled
    out, base = [], 0
    for row in sorted(made.collect()):  # one row for each partition
        out.append((row["name"], row["docs"], row["tokens"], base))
        base += row["tokens"]
    return out


def _read(uri: str):
    def run(batches):
        for batch in batches:
            for name, base in zip(column(batch, "name").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                files, lo = Reader(uri, name), 0
                while lo < len(files):
                    hi = max(lo + 1, int(np.searchsorted(files.offsets, files.offsets[lo] + (1 << 20), "right")) - 1)
                    offsets = files.offsets[lo : hi + 1]
                    ids = files.ids[offsets[0] : offsets[-1]].astype("<u4")
                    at = (4 * (offsets - offsets[0])).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.record_batch([pa.array(files.keys[lo:hi], mask=~files.given[lo:hi]), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), data], ["doc_id", "start", "n_tokens", "ids"])
                    lo = hi

    return run


def read_token_files(spark, uri: str, manifest: list[tuple[str, int, int, int]]) -> DataFrame:
    """The files' documents: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    parts = spark.createDataFrame([(name, base) for name, _, _, base in manifest], "name string, base long")
    if manifest:
        parts = parts.repartition(len(manifest), "name")
    return parts.mapInArrow(lean(_read(uri)), "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = 2, uri: str | None = None) -> DataFrame:
    """Write docs as token files and read them back: doc_id, start, n_tokens, ids."""
    uri = uri or Scratch(docs.sparkSession, "tokens").path("files")
    return read_token_files(docs.sparkSession, uri, write_token_files(docs, uri, tokenizer or default_tokenizer(), end))
