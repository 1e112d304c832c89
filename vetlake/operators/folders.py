"""What folder names say about files: labels, splits and classes, with flags where they contradict each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.keys import salted


def _known(parts: Column, names) -> Column:
    return F.arrays_overlap(parts, F.array(*(F.lit(n) for n in sorted(names)))) if names else F.lit(False)


def folder_facts(files: DataFrame, path: str = "path", normal=("normal",), anomaly=("anomaly",)) -> DataFrame:
    """files with label, original_split, class_name, base_id, augmentations, source_id and folder_flags, from the names on the path.

    Folder names count without case. A file is normal or an anomaly if a folder of one kind is above it, and of an unknown label
    with none or both; likewise for splits, by their synonyms. class_name is the folders that name no split. folder_flags names
    contradictions: conflicting_folder_labels, conflicting_folder_splits. A null path gives nulls and no flags.
    """
    parts = K.path_parts(F.col(path))
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), K.casefold)
    rows = files.withColumn("__folders", folders)
    folders = F.col("__folders")
    good, bad = _known(folders, {n.casefold() for n in normal}), _known(folders, {n.casefold() for n in anomaly})
    is_split = lambda p: p.isin(*K.SPLIT_SYNONYMS)
    splits = F.array_distinct(F.transform(F.filter(folders, is_split), K.split_name))
    base = K.base_id(K.stem(F.col(path)))
    flags = F.array(F.when(good & bad, F.lit("conflicting_folder_labels")), F.when(F.size(splits) > 1, F.lit("conflicting_folder_splits")))
    known = F.col(path).isNotNull()
    return rows.withColumns(
        {
            "label": F.when(known, F.when(good & ~bad, "normal").when(bad & ~good, "anomaly").otherwise("unknown")),
            "original_split": F.when(known, F.when(F.size(splits) == 1, F.get(splits, 0)).otherwise("unknown")),
            "class_name": F.array_join(F.filter(folders, lambda p: ~is_split(p)), "/"),
            "base_id": base,
            "augmentations": K.augmentations(K.stem(F.col(path))),
            "source_id": K.source_id(base),
            "folder_flags": F.filter(flags, lambda x: x.isNotNull()),
        }
    ).drop("__folders")


@dataclass(frozen=True)
class Place:
    """A part of a data set: the folder that holds it and the label of all its files."""

    part: str
    folder: str
    label: str


#: Where a folder convention keeps its parts.
PLACES = (Place("train_normal", "train/normal", "normal"), Place("test_clean", "test/normal", "normal"), Place("test_anomaly", "test/anomaly_real", "anomaly"))


def folder_splits(spark: SparkSession, root: str, origin: str, places: tuple[Place, ...] = PLACES, pattern: str = "*.jpg", calibration: float = 0.1, salt: str = "42") -> DataFrame:
    """The files right in each place's folder as rows of a split: part, path, base_id, source_id, group_id, split_group_id, class_id, is_original, label, is_anomaly, origin.

    All four ids are the file's stem. A share of the first place's files, picked by hash, is given again as calibration_normal.
    Files are listed, not read.
    """
    from ..sources.files import scan

    files = scan(spark, root, pattern, content=False).select("path")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    what = F.array(*(F.struct(F.lit(p.part).alias("part"), F.lit(p.folder).alias("folder"), F.lit(p.label).alias("label")) for p in places))
    rows = files.select("path", F.explode(F.filter(what, lambda p: p["folder"] == folder)).alias("place")).select("path", "place.part", "place.label")
    share = F.conv(F.substring(salted(F.col("path"), salt), 1, 8), 16, 10).cast("long") < int(calibration * 2**32)
    again = rows.where((F.col("part") == places[0].part) & share).withColumn("part", F.lit("calibration_normal"))
    stem = K.stem(F.col("path"))
    ids = {c: stem for c in ("base_id", "source_id", "group_id", "split_group_id")}
    return rows.unionAll(again).withColumns(ids | {"class_id": F.lit(0), "is_original": F.lit(True), "is_anomaly": (F.col("label") == "anomaly").cast("int"), "origin": F.lit(origin)})
