"""Session helpers of the subpackage: shared folder, written intermediate tables, clean-up, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OPEN: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="vetlake-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: a batch is held several times, by Spark and by a worker.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(64 << 20)) == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of executors. `drop` frees a table that is no longer read;
    tables behind a returned DataFrame stay until the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/vetlake-{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @contextlib.contextmanager
    def _cleaning(self):
        """While a table is written: Spark removes the query's shuffle files when it has ended, as nothing reads them again."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.save(df, name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save(self, df: DataFrame, name: str) -> None:
        with self._cleaning():
            df.write.parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove_path(self.spark, self.path(name))

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now rather than at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@atexit.register
def _close() -> None:
    for scratch in _OPEN:
        try:
            if scratch.spark.sparkContext._jsc is not None:
                remove_path(scratch.spark, scratch.root)
        except Exception:  # the session is gone: its shared folder is the cluster's to clean
            return


def lean(run):
    """A function over Arrow batches that gives its worker's freed memory back at the end: workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n + 1 offsets into them, without a copy where Arrow allows it."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19):
    """Row ranges [lo, hi) of at most `most` bytes each, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
