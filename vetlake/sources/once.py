"""A sink that writes a table once: staged Parquet files, one commit, one atomic rename, and a digest that decides about the next time."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: The last column of what is written: a hash of each row, which is summed up and not stored.
HASH = "__row_hash"
DIGEST = "_digest.json"


class AlreadyWrittenError(FileExistsError):
    """What is there differs from what was to be written once."""


def _mixed(h: int) -> int:
    return int.from_bytes(hashlib.blake2b(h.to_bytes(8, "little", signed=True), digest_size=16).digest(), "little")


@dataclass
class Written(WriterCommitMessage):
    """One task's file, its rows, and the sum of their mixed hashes, which no order changes."""

    file: str | None
    rows: int
    total: int


class _Folder:
    """Few steps on a folder in a store that renames folders at once: the local one, or HDFS."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://") if path.startswith("file://") else path
        self.store = None
        if "://" in self.path:
            scheme = path.split("://")[0]
            if scheme not in ("hdfs", "viewfs"):
                raise ValueError(f"{scheme} has no atomic rename of folders")
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(path)

    def make(self, path: str) -> None:
        self.store.create_dir(path) if self.store else os.makedirs(path, exist_ok=True)

    def write(self, path: str, data: bytes) -> None:
        with self.store.open_output_stream(path) if self.store else open(path, "wb") as f:
            f.write(data)

    def read(self, path: str) -> bytes | None:
        try:
            with self.store.open_input_stream(path) if self.store else open(path, "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def exists(self, path: str) -> bool:
        if self.store:
            return self.store.get_file_info(path).type.name != "NotFound"
        return os.path.exists(path)

    def names(self, path: str) -> list[str]:
        if self.store:
            from pyarrow import fs

            return [i.base_name for i in self.store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        return os.listdir(path) if os.path.isdir(path) else []

    def drop(self, path: str) -> None:
        if self.store:
            self.store.delete_dir(path) if self.exists(path) else None
        else:
            shutil.rmtree(path, ignore_errors=True)

    def drop_file(self, path: str) -> None:
        self.store.delete_file(path) if self.store else os.remove(path)

    def rename(self, path: str, to: str) -> bool:
        """Whether path is now called `to`; False if there is such a folder already."""
        try:
            self.store.move(path, to) if self.store else os.rename(path, to)
        except OSError:
            if self.exists(to):
                return False
            raise
        return True


class OnceSink(DataSource):
    """df.write.format("vetlake_once").mode("append").save(path): rows with their hash (HASH) as the last column.

    Tasks write to a staging folder beside path. The commit keeps the files of tasks that succeeded, adds the digest and renames the
    folder: readers see all of it or nothing, and of two writers one renames first. If path is there already, equal content
    changes nothing and other content raises; staged files go in either case.
    """

    @classmethod
    def name(cls) -> str:
        return "vetlake_once"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _OnceWriter(self.options["path"], schema, self.options.get("writer", ""))


class _OnceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema, writer: str):
        self.path, self.schema, self.writer = path.rstrip("/"), schema, writer
        self.staging = f"{_Folder(self.path).path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, out, rows, total = _Folder(self.path), f"part-{uuid.uuid4().hex}.parquet", None, 0, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                rows += batch.num_rows
                total += sum(map(_mixed, batch.column(batch.num_columns - 1).to_pylist()))
                batch = batch.select(range(batch.num_columns - 1))
                if out is None:
                    folder.make(self.staging)
                    out = pq.ParquetWriter(f"{self.staging}/{name}", batch.schema, filesystem=folder.store)
                out.write_batch(batch)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows, total % (1 << 128))

    def commit(self, messages: list[Written | None]) -> None:
        folder = _Folder(self.path)
        done = [m for m in messages if m is not None]
        kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in self.schema.fields[:-1])
        total = sum(m.total for m in done) % (1 << 128)
        content = hashlib.sha256(f"{kinds}|{sum(m.rows for m in done)}|{total}".encode()).hexdigest()
        try:
            if not folder.exists(folder.path):
                folder.make(self.staging)
                kept = {m.file for m in done}
                for name in folder.names(self.staging):  # of attempts that did not succeed
                    if name not in kept:
                        folder.drop_file(f"{self.staging}/{name}")
                if not any(kept):
                    pq.write_table(to_arrow_schema(self.schema).empty_table().drop_columns([HASH]), f"{self.staging}/part-none.parquet", filesystem=folder.store)
                folder.write(f"{self.staging}/{DIGEST}", json.dumps({"content": content, "writer": self.writer}).encode())
                if folder.rename(self.staging, folder.path):
                    return
            there = folder.read(f"{folder.path}/{DIGEST}")
            if there is None or json.loads(there)["content"] != content:
                raise AlreadyWrittenError(self.path)
        finally:
            folder.drop(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        _Folder(self.path).drop(self.staging)
