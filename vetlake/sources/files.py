"""File sources: recursive scans, candidates, label files, tables as text, JSON, archives."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_name, split_name, suffix
from .registry import register
from .tree import BYTES, EXCLUDED, ArchiveSource, TreeSource

# Image extensions, and the first bytes of files that only accompany others.
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".gif", ".ppm", ".pgm")
SIDECAR = "00051607"

#: The inventory's columns.
MANIFEST = (
    "path string, status string, error string, format string, width int, height int, mode string, channels int, frames int, label string, class_name string, "
    "original_split string, base_id string, augmentations array<string>, sha256 string, pixel_sha256 string, phash string, mean double, std double, group_id string, "
    "flags array<string>, class_id int, source_id string, supplied_splits array<string>, supplied_row_count int, supplied_split_row_counts map<string, int>"
)


def with_status(rows: DataFrame) -> DataFrame:
    """rows (path, length, content) with status: ok, auxiliary (a sidecar), corrupt (an empty image) or unsupported."""
    image = suffix(F.col("path")).isin(*IMAGES)
    first = F.hex(F.substring("content", 1, 4))
    return rows.withColumn("status", F.when(file_name(F.col("path")).startswith("._") & (first == SIDECAR), "auxiliary").when(image & (F.col("length") == 0), "corrupt").when(image, "ok").otherwise("unsupported"))


def scan(spark: SparkSession, root: str, pattern: str | None = None, content: bool = True) -> DataFrame:
    """path (below root), length, content and status of the files below root; excluded folders are left out, links not followed.

    Empty files and names that begin with a dot or an underscore are rows too. Without `content` files are listed, not read.
    """
    read = spark.read.format(register(spark, TreeSource)).option("content", str(content).lower())
    return with_status((read.option("glob", pattern) if pattern else read).load(root))


def candidates(files: DataFrame) -> DataFrame:
    """Top folders that hold an image: root; "" is the scanned folder itself, for images right in it."""
    own = files.where(suffix(F.col("path")).isin(*IMAGES))
    return own.select(F.when(F.col("path").contains("/"), F.get(F.split("path", "/"), 0)).otherwise("").alias("root")).distinct()


def safe_paths(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path stays below its root: relative, and no step upward."""
    return rows.where(~F.col(path).startswith("/") & ~F.array_contains(F.split(path, "/"), ".."))


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """A white-space text of `name class` or `name class split` -> name, class_id, split (its usual name); other lines have an error."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    number = F.get("p", 1)
    split = split_name(F.get("p", 2))
    wrong = ~F.size("p").isin(2, 3) | ~F.coalesce(number.rlike("^[0-9]+$"), F.lit(False)) | ((F.size("p") == 3) & split.isNull())
    return rows.select(F.get("p", 0).alias("name"), F.when(~wrong, number.cast("int")).alias("class_id"), split.alias("split"), wrong.alias("error"))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of `id,name`, with or without a header, -> class_id, class_name."""
    rows = spark.read.schema("class_id string, class_name string").csv(path)
    return rows.where(F.trim("class_id").rlike("^[0-9]+$")).select(F.trim("class_id").cast("int").alias("class_id"), F.trim("class_name").alias("class_name"))


def label_conflicts(labels: DataFrame) -> DataFrame:
    """Names that are given more than one class."""
    return labels.groupBy("name").agg(F.count_distinct("class_id").alias("classes")).where("classes > 1")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with all columns as strings; a byte-order mark is dropped from the header."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def csv_typed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def csv_history(spark: SparkSession, root: str, name: str = "predictions.csv") -> DataFrame:
    """All files of a name below root, as strings, with the `file` they come from."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root).withColumn("file", F.input_file_name())


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def integer(column: str) -> F.Column:
    """An integer that a text may write as 3 or 3.0; null for anything else."""
    return F.expr(f"cast(try_cast(`{column}` as double) as int)")


def literal_list(column: str) -> F.Column:
    """A list that an older CSV holds as ['a', 'b']."""
    return F.from_json(F.translate(column, "'", '"'), "array<string>")


def archive(spark: SparkSession, path: str, md5: str | None = None, partition_bytes: int = BYTES) -> DataFrame:
    """The files of a zip or tar: archive, path (without its top folder), content, status; read member by member, by several tasks.

    An archive whose MD5 is not the given one is one row without a path, of status "wrong checksum". Links and paths that lead
    outside are rejected and have no content.
    """
    read = spark.read.format(register(spark, ArchiveSource)).option("bytes", str(partition_bytes))
    return (read.option("md5", md5) if md5 else read).load(path)


def images(files: DataFrame, decode, size: int) -> DataFrame:
    """path, pixels (row-major, 0 to 1) of decoded files. decode(bytes, size) returns a size x size array of bytes and runs on the executors."""

    def run(batches):
        for batch in batches:
            made = [(decode(c, size) / 255.0).ravel().tolist() for c in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["path", "pixels"])

    return files.where("status = 'ok'").select("path", "content").mapInArrow(run, "path string, pixels array<double>")
