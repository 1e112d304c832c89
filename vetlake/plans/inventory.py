"""Inventory reports and duplicates over documents, labels, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import audit as A
from ..operators import graph as G
from ..operators.folders import folder_facts
from ..sources.fixtures import MANIFEST, manifest, table
from . import query

#: The split that a document's hash gives it, for reports of splits.
SPLIT = "CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END"
_SPLIT_SQL = f"{MANIFEST}, s AS (SELECT *, {SPLIT} AS split FROM (SELECT *, CAST('0x' || substr(sha256('42' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS h FROM m))"


def with_split(rows):
    h = F.conv(F.substring(K.salted(F.col("doc_id")), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(h < 70, "train").when(h < 85, "val").otherwise("test"))


def inventory(spark, sf_dir):
    return with_split(manifest(spark, sf_dir))


@query(f"WITH {MANIFEST} SELECT label, count(*) AS n FROM m GROUP BY label")
def status_histogram(spark, sf_dir):
    return A.histogram(manifest(spark, sf_dir), "label")


@query(f"WITH {_SPLIT_SQL} SELECT label, split, count(*) AS n FROM s GROUP BY label, split")
def label_by_split(spark, sf_dir):
    return A.histogram(inventory(spark, sf_dir), "label", "split")


@query(f"WITH {_SPLIT_SQL} SELECT class_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s WHERE class_name IS NOT NULL GROUP BY class_name")
def class_by_split_pivot(spark, sf_dir):
    return inventory(spark, sf_dir).where("class_name is not null").groupBy("class_name").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query("SELECT t AS token, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS t FROM pages) WHERE t <> '' GROUP BY t")
def token_histogram(spark, sf_dir):
    parts = F.explode(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")).alias("token")
    return A.histogram(table(spark, sf_dir, "pages").select(parts).where("token <> ''"), "token")


@query(f"WITH {MANIFEST} SELECT class_name, count(*) AS rows, count(DISTINCT sha256) AS contents, count(DISTINCT source_id) AS sources, count(*) FILTER (is_anomaly = 1) AS anomalies FROM m WHERE class_name IS NOT NULL GROUP BY class_name")
def class_distribution(spark, sf_dir):
    return A.class_distribution(manifest(spark, sf_dir), "class_name", "source_id")


@query(f"WITH {MANIFEST}, c AS (SELECT count(*) AS n FROM m WHERE class_name IS NOT NULL GROUP BY class_name) SELECT max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share, round(max(n) / nullif(min(n), 0), 6) AS largest_to_smallest FROM c")
def class_imbalance(spark, sf_dir):
    out = A.imbalance(A.histogram(manifest(spark, sf_dir), "class_name"))
    return out.select("largest", F.round("largest_share", 6).alias("largest_share"), F.round("largest_to_smallest", 6).alias("largest_to_smallest"))


@query(f"WITH {MANIFEST} SELECT sha256 AS base_id, count(*) AS members, count(*) FILTER (is_anomaly = 1) AS anomalies, string_agg(DISTINCT class_name, '|' ORDER BY class_name) AS classes, min(path) AS first_path FROM m GROUP BY sha256")
def base_group_report(spark, sf_dir):
    classes = F.array_join(F.array_sort(F.collect_set("class_name")), "|").alias("classes")
    return manifest(spark, sf_dir).groupBy(F.col("sha256").alias("base_id")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"), classes, F.min("path").alias("first_path"))


@query(f"WITH {MANIFEST}, c AS (SELECT count(*) AS size FROM m GROUP BY sha256) SELECT size, count(*) AS groups FROM c GROUP BY size")
def group_size_hist(spark, sf_dir):
    return A.group_sizes(manifest(spark, sf_dir), "sha256")


@query(f"WITH {MANIFEST} SELECT sha256, count(*) AS members, min(path) AS first, substr(sha256(string_agg(path, chr(10) ORDER BY path)), 1, 16) AS group_id FROM m GROUP BY sha256 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return A.duplicate_groups(manifest(spark, sf_dir), "sha256", "path")


@query(f"WITH {MANIFEST}, k AS (SELECT * FROM m WHERE label <> 'unknown') SELECT source_id, count(DISTINCT label) AS n_values, string_agg(DISTINCT label, '|' ORDER BY label) AS values FROM k GROUP BY source_id HAVING count(DISTINCT label) > 1")
def label_conflict_groups(spark, sf_dir):
    return A.spanning(manifest(spark, sf_dir), "source_id", "label")


@query(f"WITH {_SPLIT_SQL} SELECT sha256, count(DISTINCT split) AS n_values, string_agg(DISTINCT split, '|' ORDER BY split) AS values FROM s GROUP BY sha256 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return A.spanning(inventory(spark, sf_dir), "sha256", "split")


@query(f"WITH {_SPLIT_SQL}, g AS (SELECT source_id, count(DISTINCT split) AS k FROM s GROUP BY source_id), b AS (SELECT sha256, count(DISTINCT split) AS k FROM s GROUP BY sha256) SELECT (SELECT count(*) FROM g WHERE k > 1) AS sources, (SELECT count(*) FROM b WHERE k > 1) AS bases")
def overlap_counts(spark, sf_dir):
    rows = inventory(spark, sf_dir)
    n = lambda key, name: A.spanning(rows, key, "split").agg(F.count(F.lit(1)).alias(name))
    return n("source_id", "sources").crossJoin(n("sha256", "bases"))  # one row each


@query("""WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'a' ELSE 'b' END AS split FROM labels UNION ALL SELECT conv_id, 'c' FROM conversations),
e AS (SELECT doc_id, count(*) AS n, count(DISTINCT split) AS k FROM l GROUP BY doc_id)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS "unique", CAST(sum(greatest(0, n - 1)) AS BIGINT) AS repeats, count(*) FILTER (k > 1) AS in_several_splits,
(SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS absent FROM e""")
def label_file_report(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "a").otherwise("b").alias("split"))
    labels = labels.unionAll(table(spark, sf_dir, "conversations").select("conv_id", F.lit("c")))
    return A.label_report(labels, table(spark, sf_dir, "documents"), "doc_id", "split")


_OUT = f"""{_SPLIT_SQL}, o AS (SELECT * FROM s WHERE label = 'normal' AND split = 'train'), a AS (SELECT quantile_cont(value, 0.5) AS med, count(value) AS n FROM o),
d AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM o, a), x AS (SELECT s.*, label = 'normal' AND split = 'train' AND n >= 5 AND abs(value - med) > greatest(20, 4.5 * 1.4826 * mad) AS outlier FROM s, a, d)"""


def _outliers(spark, sf_dir):
    return A.outlier_flag(inventory(spark, sf_dir), "value", (F.col("label") == "normal") & (F.col("split") == "train"))


@query(f"WITH {_OUT} SELECT doc_id, value FROM x WHERE outlier")
def brightness_outliers(spark, sf_dir):
    return _outliers(spark, sf_dir).where("outlier").select("doc_id", "value")


_FLAGS = "list_filter([CASE WHEN value < 50 THEN 'nearly_constant' END, CASE WHEN value > 10000 THEN 'oversized' END, CASE WHEN label = 'unknown' THEN 'missing_label' END, CASE WHEN outlier THEN 'outlier' END], lambda f: f IS NOT NULL)"


def _flagged(spark, sf_dir):
    f = A.flags(nearly_constant=F.col("value") < 50, oversized=F.col("value") > 10000, missing_label=F.col("label") == "unknown", outlier=F.col("outlier"))
    return _outliers(spark, sf_dir).withColumn("flags", f)


@query(f"WITH {_OUT} SELECT array_to_string({_FLAGS}, '|') AS flags, count(*) AS n FROM x GROUP BY 1")
def quality_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).groupBy(F.array_join("flags", "|").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_OUT}, y AS (SELECT *, {_FLAGS} AS flags FROM x) SELECT doc_id, label, array_to_string(flags, '|') AS flags FROM y WHERE split = 'train' AND (label = 'anomaly' OR (label = 'normal' AND len(flags) > 0))")
def suspicious_rows(spark, sf_dir):
    rows = _flagged(spark, sf_dir).where((F.col("split") == "train") & ((F.col("label") == "anomaly") | ((F.col("label") == "normal") & (F.size("flags") > 0))))
    return rows.select("doc_id", "label", F.array_join("flags", "|").alias("flags"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def images_without_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def labels_without_images(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").subtract(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id")))


@query(f"WITH {MANIFEST} SELECT doc_id, CASE WHEN quality IS NULL THEN -1 WHEN class_name IN ('en', 'fr') THEN 0 ELSE 1 END AS anomaly_label FROM m")
def anomaly_label_tri_state(spark, sf_dir):
    known = (~F.col("class_name").isin("en", "fr")).cast("int")
    return manifest(spark, sf_dir).select("doc_id", F.when(F.col("quality").isNull(), -1).otherwise(known).alias("anomaly_label"))


THRESHOLD = 20
_BITS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings)"
_PAIRS = f"{_BITS}, pr AS (SELECT p.vec_id AS a, q.vec_id AS b, CAST(list_sum(list_transform(list_zip(p.b, q.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM v p JOIN v q ON p.vec_id < q.vec_id), e AS (SELECT * FROM pr WHERE distance <= {THRESHOLD})"


def _signed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", K.signature_bits(F.col("embedding")).alias("bits"))


@query(f"WITH {_PAIRS} SELECT a, b, distance FROM e")
def near_duplicate_pairs(spark, sf_dir):
    return G.every_near_pair(_signed(spark, sf_dir), "vec_id", "bits", THRESHOLD)


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (x.label = y.label) AS same_class, count(*) FILTER (x.label <> y.label) AS cross_class FROM e JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b")
def near_pair_report(spark, sf_dir):
    return G.near_pair_counts(_signed(spark, sf_dir), "vec_id", "bits", "label", THRESHOLD).toDF("pairs", "same_class", "cross_class")


@query(f"""WITH RECURSIVE {_PAIRS}, t AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b),
r AS (SELECT a AS vec_id, min(b) AS root FROM c GROUP BY a), g AS (SELECT root, count(*) AS members, substr(sha256(string_agg('vec/' || CAST(vec_id AS VARCHAR), chr(10) ORDER BY 'vec/' || CAST(vec_id AS VARCHAR))), 1, 16) AS group_id FROM r GROUP BY root)
SELECT vec_id, root, group_id, members FROM r JOIN g USING (root)""")
def connected_components(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("name"))
    return G.group_ids(rows, "vec_id", "name", G.near_forest(_signed(spark, sf_dir), "vec_id", "bits", THRESHOLD))


_SAFE = f"""WITH RECURSIVE {MANIFEST}, p AS MATERIALIZED (SELECT DISTINCT sha256 AS g, source_id || '/' || class_name AS s FROM m),
l AS MATERIALIZED (SELECT DISTINCT p.g AS a, q.g AS b FROM p JOIN p q ON q.s = p.s WHERE q.g = (SELECT min(g) FROM p z WHERE z.s = p.s)), t AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT g AS a, g AS b FROM p UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b)"""


def _safe(spark, sf_dir):
    rows = manifest(spark, sf_dir).select(F.col("sha256").alias("grp"), F.concat_ws("/", "source_id", "class_name").alias("src"))
    return G.source_safe_groups(rows, "grp", "src")


@query(f"{_SAFE} SELECT a AS grp, min(b) AS split_root FROM c GROUP BY a")
def source_safe_groups(spark, sf_dir):
    return _safe(spark, sf_dir)


@query(f"{_SAFE}, r AS (SELECT a, min(b) AS root FROM c GROUP BY a), w AS (SELECT p.g FROM p JOIN r ON r.a = p.g GROUP BY p.g HAVING count(DISTINCT r.root) > 1) SELECT (SELECT count(DISTINCT a) FROM r) AS grps, (SELECT count(*) FROM w) AS in_several")
def group_nesting(spark, sf_dir):
    from ..operators.guards import spread

    made = _safe(spark, sf_dir)
    bad = spread(made, "grp", "split_root").agg(F.count(F.lit(1)).alias("in_several"))
    return made.agg(F.count_distinct("grp").alias("grps")).crossJoin(bad)  # one row each


# pages as files: every url with one of these endings, every third named like a product of the survey
_ENDINGS = ("", "-r90", "_rotate_90", "_brightness_0.8", ".rot-180", "_fh_brt", "-flip_h.brightness-1.2_R270", "_brightness", "_brightnessmap", "_rot45", "-HFLIP", "_brightness_0.8.r90")
_NAMED = "ESP_", "_RED-0050"
_FILES = f"""n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{_NAMED[0]}' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '_' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || '{_NAMED[1]}' ELSE url END
|| [{", ".join(f"'{x}'" for x in _ENDINGS)}][page_id % {len(_ENDINGS)} + 1] || '.jpg' AS path FROM pages), t AS (SELECT page_id, regexp_replace(string_split(path, '/')[-1], '([^.])\\.[^.]*$', '\\1') AS stem FROM n)"""
# Fixed value: one augmentation at the end of a name, stripped one at a time
_LAST = r"[_\-.](r(90|180|270)|rot(ate)?[_-]?(90|180|270)|fh|fv|hflip|vflip|brt|brightness([_-]?[0-9.]+)?|flip[_-]?[hv])$"
_BASES = f"""{_FILES}, s AS (SELECT page_id, stem, 0 AS n FROM t UNION ALL SELECT page_id, regexp_replace(stem, '{_LAST}', '', 'i'), n + 1 FROM s WHERE regexp_matches(stem, '{_LAST}', 'i')),
b AS (SELECT page_id, lower(arg_max(stem, n)) AS base_id, max(n) AS n FROM s GROUP BY page_id)"""


def _stems(spark, sf_dir):
    pages, id_ = table(spark, sf_dir, "pages"), F.col("page_id")
    named = F.concat(F.lit(_NAMED[0]), F.lpad(id_.cast("string"), 6, "0"), F.lit("_"), F.lpad((id_ % 10000).cast("string"), 4, "0"), F.lit(_NAMED[1]))
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (id_ % len(_ENDINGS) + 1).cast("int"))
    return pages.select("page_id", K.stem(F.concat(F.when(id_ % 3 == 0, named).otherwise(F.col("url")), ending, F.lit(".jpg"))).alias("stem"))


@query(f"WITH RECURSIVE {_BASES} SELECT page_id, base_id, CAST(n AS BIGINT) AS n_augmentations, n = 0 AS is_original FROM b")
def base_identifier(spark, sf_dir):
    found = F.size(K.augmentations(F.col("stem"))).cast("long")
    return _stems(spark, sf_dir).select("page_id", K.base_id(F.col("stem")).alias("base_id"), found.alias("n_augmentations"), (found == 0).alias("is_original"))


@query(f"WITH RECURSIVE {_BASES} SELECT page_id, nullif(regexp_extract(base_id, '^((esp|psp|tra)_[0-9]{{6}}_[0-9]{{4}})_red-[0-9]+$', 1), '') AS source_id FROM b")
def source_id_extract(spark, sf_dir):
    return _stems(spark, sf_dir).select("page_id", K.source_id(K.base_id(F.col("stem"))).alias("source_id"))


@query("SELECT page_id, len(string_split(url, '/')) AS n_parts, string_split(url, '/')[3] AS host, lower(string_split(url, '/')[-1]) AS last FROM pages")
def path_parts(spark, sf_dir):
    parts = K.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(parts).cast("long").alias("n_parts"), F.get(parts, 2).alias("host"), F.lower(K.file_name(F.col("url"))).alias("last"))


_SPLIT_NAMES = ("Training", "valid", "VALIDATION", "test", "other", "train", "Testing", "val")


@query(f"""WITH n AS (SELECT page_id, [{", ".join(f"'{x}'" for x in _SPLIT_NAMES)}][page_id % {len(_SPLIT_NAMES)} + 1] AS name FROM pages)
SELECT page_id, CASE WHEN lower(name) IN ('train', 'training') THEN 'train' WHEN lower(name) IN ('test', 'testing') THEN 'test' WHEN lower(name) IN ('val', 'valid', 'validation') THEN 'val' END AS split FROM n""")
def synonym_map(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _SPLIT_NAMES)), (F.col("page_id") % len(_SPLIT_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", K.split_name(name).alias("split"))


# Hosts and paths of the pages as folders, which name splits and labels, some of them two.
_FOLDERS = [("^https?://", ""), ("[#?].*$", ""), ("^m\\.", "Training."), ("^blog\\.", "normal."), ("\\.example\\.com/", ".TRAIN/"), ("\\.example\\.net/", ".valid/"), ("\\.example\\.org/", ".photos/"), ("\\.", "/")]
_FOLDER_SQL = "url"
for _pattern, _to in _FOLDERS:
    _FOLDER_SQL = f"regexp_replace({_FOLDER_SQL}, '{_pattern}', '{_to}', 'g')"


@query(f"""WITH p AS (SELECT page_id, list_transform(string_split({_FOLDER_SQL}, '/')[:-2], lambda x: lower(x)) AS f FROM pages),
q AS (SELECT page_id, len(list_intersect(f, ['normal', 'en', 'es'])) > 0 AS good, len(list_intersect(f, ['fr', 'de'])) > 0 AS bad, list_distinct(list_transform(list_filter(f, lambda x: x IN ('train', 'training', 'val', 'valid', 'validation', 'test', 'testing')),
  lambda x: CASE WHEN x LIKE 'train%' THEN 'train' WHEN x LIKE 'val%' THEN 'val' ELSE 'test' END)) AS s, list_filter(f, lambda x: x NOT IN ('train', 'training', 'val', 'valid', 'validation', 'test', 'testing')) AS c FROM p)
SELECT page_id, CASE WHEN good AND NOT bad THEN 'normal' WHEN bad AND NOT good THEN 'anomaly' ELSE 'unknown' END AS label, CASE WHEN len(s) = 1 THEN s[1] ELSE 'unknown' END AS original_split, array_to_string(c, '/') AS class_name,
concat_ws(',', CASE WHEN good AND bad THEN 'conflicting_folder_labels' END, CASE WHEN len(s) > 1 THEN 'conflicting_folder_splits' END) AS folder_flags FROM q""")
def folder_labels(spark, sf_dir):
    path = F.col("url")
    for pattern, to in _FOLDERS:
        path = F.regexp_replace(path, pattern, to)
    rows = folder_facts(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), "path", ("normal", "en", "es"), ("fr", "de"))
    return rows.select("page_id", "label", "original_split", "class_name", F.array_join("folder_flags", ",").alias("folder_flags"))
