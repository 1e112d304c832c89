"""Splits, samples, guards, exposure, job tables, set operations and validation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.kept import scratch_path
from ..functions.robust import finite
from ..operators import guards as V
from ..operators import metrics as M
from ..operators import splits as S
from ..operators.selection import quantiles
from ..sources.fixtures import MANIFEST, PREDICTIONS, manifest, predictions, table
from ..streaming import resume
from . import query

# Families and severities of the synthetic corruptions.
FAMILIES = ("stripes", "dead_pixels", "local_blur", "missing_patch", "patch_duplication", "foreign_content")
SEVERITIES = (0.15, 0.30, 0.50)
SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}

_ROLES = f"""{MANIFEST}, hs AS (SELECT DISTINCT source_id, sha256('42' || source_id) AS h FROM m), pl AS (SELECT source_id, row_number() OVER (ORDER BY h) AS place, (SELECT count(*) FROM hs) AS n FROM hs),
ro AS (SELECT source_id, CASE WHEN place <= round(0.7 * n) THEN 'train' WHEN place <= round(0.85 * n) THEN 'val' ELSE 'test' END AS assigned_split FROM pl)"""


def _roles(spark, sf_dir):
    rows = manifest(spark, sf_dir)
    return rows.join(S.grouped_split(rows, "source_id", SHARES), "source_id")


@query(f"WITH {_ROLES} SELECT assigned_split, count(DISTINCT source_id) AS groups, count(*) AS rows FROM m JOIN ro USING (source_id) GROUP BY assigned_split")
def grouped_split(spark, sf_dir):
    return _roles(spark, sf_dir).groupBy("assigned_split").agg(F.count_distinct("source_id").alias("groups"), F.count(F.lit(1)).alias("rows"))


@query(f"WITH {_ROLES} SELECT CASE assigned_split WHEN 'train' THEN 'train_normal' WHEN 'val' THEN 'calibration_normal' ELSE 'test_clean' END AS role, count(*) AS n FROM m JOIN ro USING (source_id) WHERE label = 'normal' GROUP BY 1")
def role_assignment(spark, sf_dir):
    roles = F.create_map(*(F.lit(x) for x in ("train", "train_normal", "val", "calibration_normal", "test", "test_clean")))
    return _roles(spark, sf_dir).where("label = 'normal'").groupBy(F.element_at(roles, F.col("assigned_split")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


_BAL = "SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY sha256('42' || CAST(doc_id AS VARCHAR)) DESC, doc_id) AS round FROM m WHERE class_name IS NOT NULL"


@query(f"WITH {MANIFEST}, b AS ({_BAL}) SELECT doc_id, class_name, round FROM b ORDER BY round, class_name, doc_id LIMIT 40")
def balanced_round_robin(spark, sf_dir):
    return S.balanced(manifest(spark, sf_dir), "class_name", "doc_id", 40).select("doc_id", "class_name", F.col("round").cast("long").alias("round"))


@query(f"WITH {MANIFEST} SELECT sha256, min(doc_id) AS doc_id, min_by(class_name, doc_id) AS class_name FROM m GROUP BY sha256")
def one_per_base(spark, sf_dir):
    return S.first_of(manifest(spark, sf_dir).select("sha256", "doc_id", "class_name"), ["sha256"], "doc_id")


@query("SELECT doc_id, source FROM documents WHERE CAST('0x' || substr(sha256('42' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10")
def hash_sample(spark, sf_dir):
    return S.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 10)


ATTEMPTS = 16


@query(f"""WITH {MANIFEST}, pr AS (SELECT DISTINCT source_id, class_name FROM m), tr AS (SELECT unnest(range({ATTEMPTS})) AS attempt),
g AS (SELECT attempt, source_id, row_number() OVER (PARTITION BY attempt ORDER BY sha256(CAST(attempt AS VARCHAR) || ':' || source_id)) AS place, count(*) OVER (PARTITION BY attempt) AS n FROM (SELECT DISTINCT source_id FROM pr), tr),
s AS (SELECT attempt, source_id, CASE WHEN place <= round(0.7 * n) THEN 'train' WHEN place <= round(0.85 * n) THEN 'val' ELSE 'test' END AS assigned_split FROM g),
ok AS (SELECT attempt FROM s JOIN pr USING (source_id) GROUP BY attempt HAVING count(DISTINCT assigned_split || class_name) = 3 * (SELECT count(DISTINCT class_name) FROM pr))
SELECT source_id, assigned_split, CAST(attempt AS INT) AS attempt FROM s WHERE attempt = (SELECT min(attempt) FROM ok)""")
def class_covered_split(spark, sf_dir):
    return S.covered_split(manifest(spark, sf_dir), "source_id", "class_name", SHARES, ATTEMPTS)


@query(f"WITH {_ROLES}, j AS (SELECT m.*, assigned_split FROM m JOIN ro USING (source_id)), b AS (SELECT sha256, bool_or(label <> 'normal') AS bad FROM j GROUP BY sha256) SELECT CASE WHEN assigned_split = 'train' AND bad THEN 'test' ELSE assigned_split END AS assigned_split, count(*) AS n FROM j JOIN b USING (sha256) GROUP BY 1")
def unsafe_group_move(spark, sf_dir):
    rows = S.without_unsafe(_roles(spark, sf_dir), "sha256", F.col("label") == "normal")
    return rows.groupBy("assigned_split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ROLES}, j AS (SELECT m.*, assigned_split FROM m JOIN ro USING (source_id)), k AS (SELECT assigned_split, 'sha256' AS key, sha256 AS value FROM j UNION ALL SELECT assigned_split, 'source_id', source_id FROM j UNION ALL SELECT assigned_split, 'path', path FROM j)
SELECT key, value, count(DISTINCT assigned_split) AS roles FROM k GROUP BY key, value HAVING count(DISTINCT assigned_split) > 1 OR value IS NULL OR value = ''""")
def disjoint_violations(spark, sf_dir):
    return V.shared_keys(_roles(spark, sf_dir), "assigned_split", ["sha256", "source_id", "path"])


@query(f"WITH {MANIFEST} SELECT label, count(*) AS n FROM m WHERE NOT coalesce(is_anomaly = 0 AND source_id = 'src1' AND quality BETWEEN 0 AND 1, false) GROUP BY label")
def clean_violations(spark, sf_dir):
    return V.not_clean(manifest(spark, sf_dir), "is_anomaly", "source_id", "src1", "quality", range(2)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_missing, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS documents_missing")
def subset_check(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    n = lambda a, b, name: V.missing(a, b, ["doc_id"]).agg(F.count(F.lit(1)).alias(name))
    return n(labels, docs, "labels_missing").crossJoin(n(docs, labels, "documents_missing"))  # one row each


@query(f"""WITH {MANIFEST}, c AS (SELECT DISTINCT sha256 FROM m WHERE is_anomaly = 1), g AS (SELECT DISTINCT source_id || '/' || class_name AS grp, sha256 FROM m),
u AS (SELECT DISTINCT grp FROM g JOIN c USING (sha256)) SELECT doc_id FROM m WHERE source_id || '/' || class_name NOT IN (SELECT grp FROM u)""")
def exposure_holdout(spark, sf_dir):
    rows = manifest(spark, sf_dir).withColumn("grp", F.concat_ws("/", "source_id", "class_name"))
    used = rows.where("is_anomaly = 1").select(F.lit("sha256").alias("key"), F.col("sha256").alias("value")).distinct()
    return S.untouched(rows, used, ["sha256", "path"], "grp").select("doc_id")


def _jobs(spark, sf_dir):
    grid = spark.createDataFrame([(f, s) for f in FAMILIES for s in SEVERITIES], "family string, severity double")
    rows = manifest(spark, sf_dir).where("label = 'normal'").select("doc_id").crossJoin(F.broadcast(grid))  # 18 rows
    case = F.concat_ws(":", F.col("doc_id").cast("string"), "family", F.format_string("%.2f", "severity"))
    return rows.withColumn("case_id", case).withColumn("seed", K.seed(F.concat(F.lit("42:"), "doc_id", F.lit(":"), "family")))


_JOBS = f"""{MANIFEST}, f AS (SELECT unnest([{", ".join(f"'{f}'" for f in FAMILIES)}]) AS family), s AS (SELECT unnest([0.15, 0.30, 0.50])::DOUBLE AS severity),
j AS (SELECT doc_id, family, severity, CAST(doc_id AS VARCHAR) || ':' || family || ':' || printf('%.2f', severity) AS case_id,
CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR) || ':' || family), 1, 8) AS BIGINT) AS seed FROM m, f, s WHERE label = 'normal')"""


@query(f"WITH {_JOBS} SELECT case_id, seed, severity FROM j")
def job_grid(spark, sf_dir):
    return _jobs(spark, sf_dir).select("case_id", "seed", "severity")


#: Which jobs arrive later than the others: by the last hex digit of a hash of the case.
_LATE_SQL = "substr(sha256(case_id), 64, 1) IN ('0', '1', '2', '3', '4')"


def _late():
    return F.substring(F.sha2("case_id", 256), 64, 1).isin(*"01234")


def _run(spark, jobs, later):
    """A run over the jobs that have come so far, then others come, some of the first ones among them: the folders of jobs, results and log."""
    root = scratch_path(spark, "jobs")
    folders = tuple(f"{root}/{name}" for name in ("jobs", "made", "log"))
    jobs.where(~_late()).write.parquet(folders[0])
    make = lambda df: df.withColumn("score", F.pmod(F.xxhash64("case_id"), F.lit(1000)))
    resume.run(spark, *folders, ["case_id"], make)
    later.write.mode("append").parquet(folders[0])
    return folders, make


@query(f"WITH {_JOBS} SELECT family, count(*) AS pending FROM j WHERE {_LATE_SQL} GROUP BY family")
def pending_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    (_, made, _), _ = _run(spark, jobs, jobs.where(_late()))
    return resume.pending(spark, jobs, made, ["case_id"]).groupBy("family").agg(F.count(F.lit(1)).alias("pending"))


@query(f"WITH {_JOBS} SELECT family, count(*) AS made, CAST(count(DISTINCT case_id) AS BIGINT) AS cases FROM j GROUP BY family")
def resumed_jobs(spark, sf_dir):
    # all jobs are sent again when the run goes on
    jobs = _jobs(spark, sf_dir)
    folders, make = _run(spark, jobs, jobs)
    resume.run(spark, *folders, ["case_id"], make)
    return spark.read.parquet(folders[1]).groupBy("family").agg(F.count(F.lit(1)).alias("made"), F.count_distinct("case_id").alias("cases"))


@query(f"WITH {_ROLES}, j AS (SELECT m.*, assigned_split FROM m JOIN ro USING (source_id)) SELECT assigned_split AS role, is_anomaly, count(*) AS n FROM (SELECT assigned_split, 0 AS is_anomaly FROM j WHERE label = 'normal' UNION ALL SELECT 'anomaly', 1 FROM j WHERE label = 'anomaly') GROUP BY 1, 2")
def union_splits(spark, sf_dir):
    rows = _roles(spark, sf_dir)
    clean = rows.where("label = 'normal'").select(F.col("assigned_split").alias("role"), F.lit(0).alias("is_anomaly"), "path")
    wrong = rows.where("label = 'anomaly'").select(F.lit("anomaly").alias("role"), F.lit(1).alias("is_anomaly"))
    return clean.unionByName(wrong, allowMissingColumns=True).groupBy("role", "is_anomaly").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ROLES}, j AS (SELECT DISTINCT sha256, assigned_split FROM m JOIN ro USING (source_id)) SELECT a.assigned_split AS first, b.assigned_split AS second, count(*) AS shared FROM j a JOIN j b USING (sha256) WHERE a.assigned_split < b.assigned_split GROUP BY 1, 2")
def split_overlap_counts(spark, sf_dir):
    own = _roles(spark, sf_dir).select("sha256", "assigned_split").distinct()
    a, b = own.withColumnRenamed("assigned_split", "first"), own.withColumnRenamed("assigned_split", "second")
    return a.join(b, "sha256").where("first < second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared"))


@query(f"WITH {_ROLES}, j AS (SELECT m.*, assigned_split FROM m JOIN ro USING (source_id)) SELECT count(DISTINCT sha256) AS shared FROM j WHERE assigned_split = 'train' AND sha256 IN (SELECT sha256 FROM j WHERE assigned_split = 'test')")
def split_intersection(spark, sf_dir):
    rows = _roles(spark, sf_dir)
    own = lambda s: rows.where(F.col("assigned_split") == s).select("sha256")
    return own("train").intersect(own("test")).agg(F.count(F.lit(1)).alias("shared"))


@query("""WITH h AS (SELECT conv_id, turn, length(text) AS loss FROM conversations), b AS (SELECT *, min(loss) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS best FROM h),
l AS (SELECT *, max(CASE WHEN loss = best THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_best FROM b)
SELECT conv_id, turn, best, turn - last_best AS stale, turn - last_best >= 2 AS stopped FROM l""")
def early_stop_trace(spark, sf_dir):
    upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("loss"))
    rows = rows.withColumn("best", F.min("loss").over(upto))
    last = F.max(F.when(F.col("loss") == F.col("best"), F.col("turn"))).over(upto)
    return rows.withColumn("stale", F.col("turn") - last).select("conv_id", "turn", "best", "stale", (F.col("stale") >= 2).alias("stopped"))


@query("""WITH d AS (SELECT lang AS class_id, sha256(text) AS h FROM documents), p AS (SELECT class_id, substr(h, 1, 3) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM d GROUP BY 1, 2)
SELECT class_id, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest FROM p GROUP BY class_id""")
def fingerprint(spark, sf_dir):
    return V.fingerprint(table(spark, sf_dir, "documents").select(F.col("lang").alias("class_id"), F.sha2("text", 256).alias("h")), ["class_id"], "h")


@query(f"""WITH {PREDICTIONS}, {_ROLES}, t AS (SELECT quantile_cont(score, 0.99) AS q FROM p WHERE y = 0),
k AS (SELECT count(*) FILTER (score > q AND y = 1) AS tp, count(*) FILTER (score > q AND y = 0) AS fp, count(*) FILTER (score <= q AND y = 0) AS tn, count(*) FILTER (score <= q AND y = 1) AS fn, bool_and(score IS NOT NULL AND isfinite(score)) AS finite,
avg(CASE WHEN y = 0 THEN CAST(score > q AS INT) END) AS f, avg(CASE WHEN y = 1 THEN CAST(score > q AS INT) END) AS r, avg(CASE WHEN score > q THEN y END) AS pr FROM p, t),
r AS (SELECT count(*) AS n FROM (SELECT source_id FROM m JOIN ro USING (source_id) GROUP BY source_id HAVING count(DISTINCT assigned_split) > 1)),
u AS (SELECT count(*) AS n FROM p WHERE y = 1 AND base_id NOT IN (SELECT base_id FROM p WHERE y = 0))
SELECT c AS "check", ok FROM (SELECT unnest(['benchmark_subset', 'finite_scores', 'fpr', 'precision', 'recall', 'sources_disjoint', 'threshold_share']) AS c,
unnest([u.n = 0, finite, abs(fp / (fp + tn) - k.f) <= 1e-9, abs(coalesce(tp / nullif(tp + fp, 0), 0) - coalesce(k.pr, 0)) <= 1e-9, abs(coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(k.r, 0)) <= 1e-9, r.n = 0, fp <= 0.01 * (fp + tn)]) AS ok FROM k, r, u)""")
def validate_artifacts(spark, sf_dir):
    # what a run would have recorded, by the engine's operators, against plain counts over the tables
    rows = predictions(spark, sf_dir)
    limit = quantiles(rows.where("y = 0"), [], {"limit_": ("score", 0.99)})
    flagged = rows.crossJoin(F.broadcast(limit))  # one row
    recorded = M.confusion(flagged, [], F.col("limit_"))
    over, y = F.col("score") > F.col("limit_"), F.col("y")
    plain = flagged.agg(
        (F.sum((over & (y == 1)).cast("int")) / F.sum(over.cast("int"))).alias("p"),
        F.avg(F.when(y == 1, over.cast("double"))).alias("r"),
        F.avg(F.when(y == 0, over.cast("double"))).alias("f"),
        F.bool_and(finite(F.col("score"))).alias("all_finite"),
    )
    mixed = V.shared_keys(_roles(spark, sf_dir), "assigned_split", ["source_id"]).agg(F.count(F.lit(1)).alias("mixed"))
    strange = V.missing(rows.where("y = 1"), rows.where("y = 0"), ["base_id"]).agg(F.count(F.lit(1)).alias("strange"))
    c = F.col
    every = V.checks(
        precision=V.close(c("precision"), F.coalesce("p", F.lit(0.0))),
        recall=V.close(c("recall"), F.coalesce("r", F.lit(0.0))),
        fpr=V.close(c("fpr"), c("f")),
        threshold_share=c("fp") <= 0.01 * (c("fp") + c("tn")),
        finite_scores=c("all_finite"),
        sources_disjoint=c("mixed") == 0,
        benchmark_subset=c("strange") == 0,
    )
    return recorded.crossJoin(plain).crossJoin(mixed).crossJoin(strange).select(F.explode(every).alias("x")).select("x.*")  # one row each


@query("SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS chosen FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def membership(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").agg(F.count_distinct("doc_id").alias("chosen"))


@query("SELECT lang, count(*) AS n, bool_and(text IS NOT NULL) AS complete, max(strlen(text)) AS longest FROM documents GROUP BY lang")
def complete_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("text").isNotNull()).alias("complete"), F.max(F.octet_length("text")).cast("long").alias("longest"))


@query(f"""WITH {_ROLES}, j AS (SELECT m.*, assigned_split FROM m JOIN ro USING (source_id)), k AS (SELECT assigned_split, 'sha256' AS key, sha256 AS value FROM j UNION ALL SELECT assigned_split, 'source_id', source_id FROM j),
v AS (SELECT count(*) AS violations FROM (SELECT key, value FROM k GROUP BY key, value HAVING count(DISTINCT assigned_split) > 1))
SELECT assigned_split, count(*) AS rows, count(DISTINCT sha256) AS n_sha256, count(DISTINCT source_id) AS n_source_id, any_value(violations) AS violations FROM j, v GROUP BY assigned_split""")
def protocol_report(spark, sf_dir):
    from ..operators.protocol import report

    return report(_roles(spark, sf_dir), "assigned_split", ["sha256", "source_id"])
