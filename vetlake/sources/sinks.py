"""Sinks: strict JSON, write-once tables and texts, exclusive claims, through Hadoop's file systems so that any store works."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .once import DIGEST, HASH, AlreadyWrittenError, OnceSink
from .registry import register


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str | None:
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Create a file that must not exist. A local one appears whole, by a link to a file beside it; elsewhere the store decides between two that try."""
    if path.startswith("file://") or "://" not in path:
        local = path.removeprefix("file://")
        beside = f"{local}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(local) or ".", exist_ok=True)
        with open(beside, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(beside, local)
        except FileExistsError as e:
            raise AlreadyWrittenError(path) from e
        finally:
            os.remove(beside)
        return
    target, fs = _path(spark, path)
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a text; the same text again changes nothing (False), another raises."""
    there = _read(spark, path)
    if there is None:
        try:
            _create(spark, path, text)
            return True
        except AlreadyWrittenError:  # another was first
            there = _read(spark, path)
    if there != text:
        raise AlreadyWrittenError(path)
    return False


def claim(spark: SparkSession, path: str, text: str = "") -> None:
    """Take an exclusive claim; a second one raises."""
    if _read(spark, path) is not None:
        raise AlreadyWrittenError(path)
    _create(spark, path, text)


def strict_json(value) -> str:
    """JSON without NaN or infinities: they raise."""
    return json.dumps(value, allow_nan=False, sort_keys=True, indent=2)


def save_json(spark: SparkSession, path: str, value) -> bool:
    return write_once(spark, path, strict_json(value) + "\n")


def finite_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON; a double that is not finite raises while the rows are made."""
    out = rows
    for c, kind in rows.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
            out = out.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast(kind)).otherwise(F.col(c)))
    return out.select(F.to_json(F.struct(*rows.columns)).alias(name))


def table_once(rows: DataFrame, path: str) -> bool:
    """Write a Parquet table once, whole or not at all; equal rows again change nothing (False), others raise.

    Of writers at the same time one writes, the others find its table. A task that fails leaves nothing. See sources.once.
    """
    spark, writer = rows.sparkSession, uuid.uuid4().hex
    hashed = rows.withColumn(HASH, F.xxhash64(*rows.columns))
    try:
        hashed.write.format(register(spark, OnceSink)).option("writer", writer).mode("append").save(path)
    except Exception as e:
        if AlreadyWrittenError.__name__ in str(e):
            raise AlreadyWrittenError(path) from e
        raise
    return json.loads(_read(spark, f"{path}/{DIGEST}"))["writer"] == writer


def freeze(spark: SparkSession, folder: str, files: list[str], decisions: dict[str, object], required: tuple[str, ...] = ()) -> dict:
    """Record the sha256 of input files with decisions, once; missing decisions raise."""
    missing = [d for d in required if d not in decisions]
    if missing:
        raise ValueError(f"undecided: {', '.join(missing)}")
    rows = spark.read.format("binaryFile").load(files).select("path", F.sha2("content", 256).alias("sha256"))
    value = {"files": {r["path"]: r["sha256"] for r in rows.collect()}, "decisions": decisions}  # one row for each named file
    save_json(spark, f"{folder}/frozen.json", value)
    return value
