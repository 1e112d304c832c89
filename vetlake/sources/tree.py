"""Python data sources: all files below a folder, and the members of archives, each with its own listing and partitions.

Folders and archives are local or in any store that pyarrow opens by its address. What is listed is a name and a size; contents are
read by the tasks, a few files or members at a time.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: folders that hold no data.
EXCLUDED = (".venv", ".git", "__pycache__", ".pytest_cache", ".pytest-tmp", "outputs")

#: Bytes and files of a partition, and bytes of a batch.
BYTES, FILES, BATCH = 64 << 20, 4096, 16 << 20


def _local(path: str) -> str | None:
    """The local path of an address, or None for another store."""
    if "://" not in path:
        return path.removeprefix("file:")
    return path.removeprefix("file://") if path.startswith("file://") else None


def _open(path: str):
    """A file to read at any place."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _listed(root: str, excluded: tuple[str, ...]) -> Iterator[tuple[str, str, int]]:
    """(address, path below root, size) of every file: empty ones, names with a dot or underscore first; links are not followed."""
    local = _local(root)
    if local is not None:
        if not os.path.isdir(local):
            raise FileNotFoundError(root)
        for folder, folders, names in os.walk(local):
            folders[:] = sorted(f for f in folders if f not in excluded and not os.path.islink(os.path.join(folder, f)))
            for name in sorted(names):
                at = os.path.join(folder, name)
                if not os.path.islink(at) and os.path.isfile(at):
                    yield at, os.path.relpath(at, local).replace(os.sep, "/"), os.path.getsize(at)
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    scheme = root.split("://")[0]
    for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
        below = info.path[len(base.rstrip("/")) + 1 :]
        if info.type == fs.FileType.File and not set(below.split("/")[:-1]) & set(excluded):
            yield f"{scheme}://{info.path}", below, info.size


@dataclass
class Part(InputPartition):
    """What one task reads: (address, name, size) of files, or (place, name, size) of the members of `archive`."""

    items: list[tuple]
    archive: str | None = None


def _parts(items: Iterator[tuple], most_bytes: int, archive: str | None = None) -> list[Part]:
    out, held, n = [], [], 0
    for item in items:
        if held and (n + item[2] > most_bytes or len(held) >= FILES):
            out.append(Part(held, archive))
            held, n = [], 0
        held.append(item)
        n += item[2]
    return [*out, Part(held, archive)] if held else out


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH bytes; one row at least."""
    held, n = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        n += size_of(row)
        if n >= BATCH or len(held) >= FILES:
            yield make()
            held, n = [], 0
    if held:
        yield make()


class TreeSource(DataSource):
    """Files below `path`: path (below it), length, content. Options: glob (of the name), content ("false" leaves it null), bytes (of a partition)."""

    SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    @classmethod
    def name(cls) -> str:
        return "vetlake_tree"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob")
        self.wanted, self.bytes = options.get("content", "true") == "true", int(options.get("bytes", BYTES))

    def partitions(self) -> list[Part]:
        files = _listed(self.root, EXCLUDED)
        return _parts((f for f in files if not self.glob or fnmatch.fnmatchcase(f[1].split("/")[-1], self.glob)), self.bytes) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        def rows():
            for at, name, size in partition.items:
                content = None
                if self.wanted:
                    with _open(at) as f:
                        content = f.read()
                yield name, size, content

        return _batches(rows(), TreeSource.SCHEMA, lambda r: len(r[2] or b""))


def _safe(name: str) -> tuple[str, bool]:
    """A member's path without its top folder, and whether it stays below where it is put."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return "/".join(parts[1:] if len(parts) > 1 else parts), ".." not in parts and not name.startswith("/")


class ArchiveSource(DataSource):
    """Members of the zip or tar at `path`: archive, path, content, status ("ok", "rejected" for links and paths that lead outside, "wrong checksum").

    Members are dealt to tasks by their sizes; tasks read their own members alone. A compressed tar can only be read from its
    start, so it is one partition, read member by member. Options: md5, bytes (of a partition).
    """

    SCHEMA = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("status", pa.string())])

    @classmethod
    def name(cls) -> str:
        return "vetlake_archive"

    def schema(self) -> str:
        return "archive string, path string, content binary, status string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.md5, self.bytes = options["path"], options.get("md5"), int(options.get("bytes", BYTES))

    def _checksum(self) -> str:
        found = hashlib.md5()
        with _open(self.path) as f:
            while block := f.read(1 << 20):
                found.update(block)
        return found.hexdigest()

    def partitions(self) -> list[Part]:
        """Members as (place, name, size): a zip's are found by name, a tar's by their offset; no place: rejected; a place of -1: all of a compressed tar."""
        if self.md5 and self._checksum() != self.md5.lower():
            return [Part([("wrong checksum", None, 0)], self.path)]
        with _open(self.path) as f:
            if zipfile.is_zipfile(f):
                with zipfile.ZipFile(f) as z:
                    links = {i.filename for i in z.infolist() if (i.external_attr >> 16) & 0o170000 == 0o120000}
                    items = [(None if i.filename in links else "zip", i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                return _parts(iter(items), self.bytes, self.path) or [Part([], self.path)]
            f.seek(0)
            try:
                with tarfile.open(fileobj=f, mode="r:") as t:
                    items = [(m.offset_data if m.isreg() and not m.issparse() else None, m.name, m.size) for m in t if not m.isdir()]
            except tarfile.ReadError:
                return [Part([(-1, None, 0)], self.path)]
            return _parts(iter(items), self.bytes, self.path) or [Part([], self.path)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(self._rows(partition), ArchiveSource.SCHEMA, lambda r: len(r[2] or b""))

    def _rows(self, partition: Part) -> Iterator[tuple]:
        if not partition.items:
            return
        first = partition.items[0][0]
        if first == "wrong checksum":
            yield self.path, None, None, first
            return
        with _open(self.path) as f:
            if first == -1:
                with tarfile.open(fileobj=f, mode="r|*") as t:
                    for m in t:
                        if not m.isdir():
                            name, safe = _safe(m.name)
                            good = safe and m.isreg()
                            yield self.path, name, t.extractfile(m).read() if good else None, "ok" if good else "rejected"
                return
            z = zipfile.ZipFile(f) if any(place == "zip" for place, _, _ in partition.items) else None
            for place, member, size in partition.items:
                name, safe = _safe(member)
                if place is None or not safe:
                    yield self.path, name, None, "rejected"
                elif place == "zip":
                    yield self.path, name, z.read(member), "ok"
                else:
                    f.seek(place)
                    yield self.path, name, f.read(size), "ok"
