"""Licence scans: sparse TF-IDF cosine of lines to licence templates, then inheritance along directories.

Every line of every file that shares a telling word with a template is compared with the templates as sparse TF-IDF
vectors, joined on words; document frequencies count all files. A file's own licence is the best match of its lines. A file
without one takes that of the nearest ancestor directory with a licence file, found by joining each directory's ancestor
paths. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed texts: the notices by which works commonly name their licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "Copyright. All rights reserved",
}
#: Words of templates that occur everywhere and do not make a line a candidate.
COMMON = ("a", "and", "are", "by", "forms", "in", "into", "is", "of", "or", "the", "this", "to", "under", "use", "with", "without", "work")
LEAST = 0.6


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9.+-]+"), lambda w: F.regexp_replace(w, "[.+-]", "") != "")


def _plain(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, "^[.+-]+|[.+-]+$", ""))


def scan(files: DataFrame, path: str = "path", is_licence_file: Column | None = None, least: float = LEAST, templates: dict[str, str] | None = None) -> DataFrame:
    """files (path, text) -> path, own_licence, similarity, licence, licence_dir.

    own_licence is the best template of the file's lines, with its cosine, where that is at least `least` (ties: the name
    that sorts first). licence is own_licence, else that of the nearest ancestor directory (its own first) with a licence
    file: one for which is_licence_file holds (by default by its name) and that has an own licence; of several, the one
    whose path sorts first. licence_dir names that directory ("" is the root), null for an own or no licence.
    One row for each row of files. Null and empty texts have no own licence; a null path inherits nothing. Other columns
    are ignored, except by is_licence_file.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licences")
    templates = templates or TEMPLATES
    if is_licence_file is None:
        is_licence_file = F.element_at(F.split(F.col(path), "/"), -1).rlike("(?i)^(licen[cs]e|copying|notice)([.-]|$)")
    known = spark.createDataFrame(sorted(templates.items()), "licence string, template string")
    terms = known.select("licence", F.explode(_plain(_tokens(F.col("template")))).alias("word")).groupBy("licence", "word").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = sorted({r[0] for r in terms.select("word").distinct().collect()})  # the templates' words
    telling = [w for w in vocabulary if w not in COMMON and not w.replace(".", "").isdigit()]
    words = F.array(*map(F.lit, vocabulary))

    line = F.filter(F.split(F.col("text").cast("string"), "[\\n\\r]+"), lambda x: x.rlike("(?i)(?<![a-z0-9])(" + "|".join(w.replace(".", "\\.").replace("+", "\\+") for w in telling) + ")(?![a-z0-9])"))
    rows = files.select(F.col(path).cast("string").alias("path"), F.coalesce(is_licence_file, F.lit(False)).alias("is_file"), F.array_distinct(line).alias("lines"), F.array_intersect(_plain(_tokens(F.col("text").cast("string"))), words).alias("known"))
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    often = rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weight = terms.select("word").distinct().join(often, "word", "left").select("word", idf.alias("idf"))
    weight = scratch.write(weight, "weights")  # one row for each word of the templates
    most = F.lit(weight.agg(F.avg("idf")).first()[0])
    vectors = terms.join(weight, "word").select("licence", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norms = vectors.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = vectors.join(norms, "licence").select("licence", "word", (F.col("w") / F.col("norm")).alias("t"))

    lines = rows.select("row", F.posexplode("lines").alias("nth", "line")).select("row", "nth", F.explode(_plain(_tokens(F.col("line")))).alias("word"))
    counted = lines.groupBy("row", "nth", "word").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(weight), "word", "left")
    counted = counted.withColumn("w", F.col("tf") * F.coalesce("idf", most))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("row", "nth")))
    scored = counted.withColumn("size", size).join(F.broadcast(vectors), "word").groupBy("row", "nth", "licence").agg(F.sum(F.col("w") * F.col("t") / F.col("size")).alias("s"))
    best = scored.where(F.round("s", 9) >= least).groupBy("row").agg(F.min(F.struct((-F.round("s", 9)).alias("s"), "licence")).alias("best"))
    own = rows.select("row", "path", "is_file").join(best, "row", "left").select("path", "is_file", F.col("best.licence").alias("own_licence"), (-F.col("best.s")).alias("similarity"))
    own = own.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    own = scratch.write(own, "own")
    scratch.drop("rows")

    declared = own.where("is_file and own_licence is not null and dir is not null").groupBy("dir").agg(F.min_by("own_licence", "path").alias("licence"))
    dirs = own.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    above = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(chain)).alias("a")).select("dir", "a.*")
    near = above.join(declared.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("n"))
    # one row for each directory; written, so that the join below stands alone and a directory with very many files can be split
    near = scratch.write(near.select("dir", F.col("n.above").alias("above"), F.col("n.licence").alias("inherited")), "near")
    full = own.join(near, "dir", "left")
    return full.select("path", "own_licence", "similarity", F.coalesce("own_licence", "inherited").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("above")).alias("licence_dir"))
