"""Curves, areas, confusion counts, slices, pairs, prevalence and bootstrap over scored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.bootstrap import bootstrap_auroc
from ..sources.fixtures import PREDICTIONS, predictions
from . import query

#: The detector's threshold on the events' values in these queries.
THRESHOLD = 100.0


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _slices(dimension: str) -> str:
    return f"""{PREDICTIONS}, s AS (SELECT DISTINCT {dimension} AS slice FROM p WHERE y = 1),
m AS (SELECT s.slice, p.* FROM p CROSS JOIN s WHERE p.y = 0 OR p.{dimension} = s.slice)"""


_BLOCKS = """c AS (SELECT slice, score, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY slice, score),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY slice ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)"""
_CURVE = f"""WITH {PREDICTIONS}, c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY score), t AS (SELECT sum(pos) AS np, sum(neg) AS nn FROM c),
k AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, np, nn FROM c, t WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _by(dimension: str):
    def f(spark, sf_dir):
        rows = predictions(spark, sf_dir)
        kind = dict(rows.dtypes)[dimension]
        return M.slice_auroc(rows, [dimension]).select(F.col("slice").cast(kind).alias("slice"), "positives", "negatives", r("auroc"))

    sql = f"""WITH {_slices(dimension)}, {_BLOCKS} SELECT slice, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
round(sum(pos * (below + 0.5::DOUBLE * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0), 6) AS auroc FROM k GROUP BY slice"""
    query(sql, f"roc_auc_by_{dimension}")(f)


_by("family")
_by("severity")


@query(f"{_CURVE} SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM k")
def roc_curve(spark, sf_dir):
    return M.curve(predictions(spark, sf_dir), []).select("threshold", "tp", "fp", r("tpr"), r("fpr"))


@query(f"{_CURVE} SELECT score AS threshold, round(tp / np, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM k")
def pr_curve(spark, sf_dir):
    return M.curve(predictions(spark, sf_dir), []).select("threshold", F.round("tpr", 6).alias("recall"), r("precision"))


@query(f"{_CURVE} SELECT CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives, round(sum((neg / nn) * (2 * tp - pos) / np / 2), 6) AS auroc FROM k")
def auroc_trapezoid(spark, sf_dir):
    return M.areas(predictions(spark, sf_dir), []).select("positives", "negatives", r("auroc"))


@query(f"{_CURVE} SELECT CAST(max(np) AS BIGINT) AS positives, round(sum((pos / np) * (tp / (tp + fp))), 6) AS auprc FROM k")
def auprc_step(spark, sf_dir):
    return M.areas(predictions(spark, sf_dir), []).select("positives", r("auprc"))


_COUNTS = f"""count(*) FILTER (score > {THRESHOLD} AND y = 1) AS tp, count(*) FILTER (score > {THRESHOLD} AND y = 0) AS fp,
count(*) FILTER (score <= {THRESHOLD} AND y = 0) AS tn, count(*) FILTER (score <= {THRESHOLD} AND y = 1) AS fn"""
_RATES = """tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(fp / nullif(tn + fp, 0), 6) AS fpr,
round(CASE WHEN tp + fn > 0 THEN (tp / (tp + fn) + tn / nullif(tn + fp, 0)) / 2 END, 6) AS balanced_accuracy"""
_RATE_NAMES = ("precision", "recall", "f1", "specificity", "fpr", "balanced_accuracy")


@query(f"WITH {PREDICTIONS}, k AS (SELECT {_COUNTS} FROM p) SELECT {_RATES} FROM k")
def confusion_metrics(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir), [], F.lit(THRESHOLD)).select("tp", "fp", "tn", "fn", *map(r, _RATE_NAMES))


_BOTH = f"""WITH {PREDICTIONS}, s AS (SELECT DISTINCT 'family' AS dimension, family AS value FROM p WHERE y = 1 UNION ALL SELECT DISTINCT 'severity', CAST(severity AS VARCHAR) FROM p WHERE y = 1),
m AS (SELECT s.dimension, s.value, p.score, p.y FROM p CROSS JOIN s WHERE p.y = 0 OR (s.dimension = 'family' AND p.family = s.value) OR (s.dimension = 'severity' AND CAST(p.severity AS VARCHAR) = s.value)),
k AS (SELECT dimension, value, {_COUNTS} FROM m GROUP BY dimension, value)"""


@query(f"{_BOTH} SELECT dimension, value, {_RATES} FROM k")
def confusion_by_slice(spark, sf_dir):
    out = M.slice_confusion(predictions(spark, sf_dir), ["family", "severity"], F.lit(THRESHOLD))
    return out.select("dimension", F.col("slice").alias("value"), "tp", "fp", "tn", "fn", *map(r, _RATE_NAMES))


@query(f"WITH {PREDICTIONS} SELECT y AS actual, count(*) FILTER (score <= {THRESHOLD}) AS predicted_normal, count(*) FILTER (score > {THRESHOLD}) AS predicted_anomaly FROM p GROUP BY y")
def confusion_pivot(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.col("y").alias("actual"), F.when(F.col("score") > THRESHOLD, "predicted_anomaly").otherwise("predicted_normal").alias("predicted"))
    return rows.groupBy("actual").pivot("predicted", ["predicted_normal", "predicted_anomaly"]).count().na.fill(0)


@query(f"WITH {PREDICTIONS}, k AS (SELECT {_COUNTS} FROM p), q AS (SELECT {_RATES} FROM k), z AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, f1, fpr FROM q) UNPIVOT z ON tp, fp, precision, recall, f1, fpr INTO NAME metric VALUE value")
def metrics_unpivot(spark, sf_dir):
    wide = confusion_metrics(spark, sf_dir).select(*(F.col(c).cast("double") for c in ("tp", "fp", "precision", "recall", "f1", "fpr")))
    return wide.unpivot([], list(wide.columns), "metric", "value")


@query(f"""WITH {PREDICTIONS}, c AS (SELECT base_id, max_by(score, event_id) AS clean FROM p WHERE y = 0 GROUP BY base_id)
SELECT p.family, count(*) AS paired_n, round(avg(CASE WHEN p.score > c.clean THEN 1.0 ELSE 0.0 END), 6) AS paired_anomaly_gt_clean FROM p JOIN c USING (base_id) WHERE y = 1 GROUP BY p.family""")
def paired_gt_clean(spark, sf_dir):
    return M.paired_share(predictions(spark, sf_dir), "base_id", "event_id", ["family"]).select("family", "paired_n", r("paired_anomaly_gt_clean"))


@query(f"WITH {PREDICTIONS} SELECT event_type AS class_id, count(*) AS n, count(*) FILTER (score > {THRESHOLD}) AS flagged, round(avg(CASE WHEN score > {THRESHOLD} THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM p WHERE y = 0 AND event_type IS NOT NULL GROUP BY event_type")
def fpr_by_class(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("y = 0 and event_type is not null")
    flagged = F.col("score") > THRESHOLD
    return rows.groupBy(F.col("event_type").alias("class_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"), F.round(F.avg(flagged.cast("double")), 6).alias("fpr"))


@query(f"""{_CURVE}, pi AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS prevalence),
a AS (SELECT prevalence, sum((pos / np) * prevalence * (tp / np) / (prevalence * (tp / np) + (1 - prevalence) * (fp / nn))) AS ap FROM k, pi GROUP BY prevalence),
q AS (SELECT count(*) FILTER (score > {THRESHOLD} AND y = 1) / count(*) FILTER (y = 1) AS tpr, count(*) FILTER (score > {THRESHOLD} AND y = 0) / count(*) FILTER (y = 0) AS fpr FROM p)
SELECT prevalence, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(prevalence * tpr / (prevalence * tpr + (1 - prevalence) * fpr), 6) AS expected_precision,
round(ap, 6) AS reweighted_average_precision, round(1000 * (1 - prevalence) * fpr, 6) AS false_alerts_per_1000, round(1000 * prevalence * tpr, 6) AS true_alerts_per_1000 FROM a JOIN pi USING (prevalence), q""")
def prevalence_sensitivity(spark, sf_dir):
    out = M.at_prevalence(predictions(spark, sf_dir), [], THRESHOLD, [0.01, 0.05, 0.1])
    return out.select("prevalence", *map(r, ("tpr", "fpr", "expected_precision", "reweighted_average_precision", "false_alerts_per_1000", "true_alerts_per_1000")))


def _top(name: str, where: str, order: str, n: int) -> None:
    def f(spark, sf_dir):
        column, _, way = order.partition(" ")
        first = F.col(column).desc() if way else F.col(column).asc()
        return predictions(spark, sf_dir).where(where).orderBy(first, "event_id").limit(n).select("event_id", "base_id", "score", "family")

    query(f"WITH {PREDICTIONS} SELECT event_id, base_id, score, family FROM p WHERE {where} ORDER BY {order}, event_id LIMIT {n}", name)(f)


_top("false_positives_topk", f"y = 0 AND score > {THRESHOLD}", "score DESC", 5)
_top("missed_bottomk", f"y = 1 AND score <= {THRESHOLD}", "score", 10)
_top("top_clean", "y = 0", "score DESC", 1)

REPLICATES = 20
#: Draws go down a binary tree over the bits of the units' hashes; the left side's count is the least k whose binomial distribution function reaches a hashed uniform number.
_LEFT = """CASE WHEN nl = 0 THEN 0 WHEN nl = n THEN m ELSE len(list_filter(list_transform(range(1, m + 2), lambda i: list_sum(list_transform(range(0, i), lambda k: exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(nl / n) + (m - k) * ln(1 - nl / n))))), lambda c: c < u)) END"""


@query(f"""WITH RECURSIVE {PREDICTIONS}, un AS MATERIALIZED (SELECT base_id, lpad(bin(CAST('0x' || substr(sha256(CAST(base_id AS VARCHAR)), 1, 8) AS UBIGINT)), 32, '0') AS bits FROM (SELECT DISTINCT base_id FROM p)),
nodes AS MATERIALIZED (SELECT substr(bits, 1, d) AS path, count(*) AS n FROM un, (SELECT unnest(range(33)) AS d) GROUP BY 1),
t AS (SELECT r, '' AS path, n, n AS m FROM nodes, (SELECT unnest(range({REPLICATES})) AS r) WHERE path = ''
  UNION ALL SELECT r, path || side, CASE WHEN side = '0' THEN nl ELSE n - nl END, CASE WHEN side = '0' THEN k ELSE m - k END FROM (SELECT *, {_LEFT} AS k FROM (
    SELECT r, t.path, t.n, m, coalesce(l.n, 0) AS nl, (CAST('0x' || substr(sha256('42:' || r || ':' || t.path), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0 AS u FROM t LEFT JOIN nodes l ON l.path = t.path || '0' WHERE t.n > 1 AND length(t.path) < 32)), (SELECT unnest(['0', '1']) AS side)
  WHERE CASE WHEN side = '0' THEN nl ELSE n - nl END > 0),
w AS (SELECT r, base_id, m AS times FROM t JOIN un ON substr(bits, 1, length(path)) = path WHERE n = 1),
c AS (SELECT r, score, sum(y * times) AS pos, sum((1 - y) * times) AS neg FROM p JOIN w USING (base_id) WHERE times > 0 GROUP BY r, score),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT r, sum(pos * (below + 0.5::DOUBLE * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auroc FROM k GROUP BY r)
SELECT count(auroc) AS replicates, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high, round(avg(auroc), 6) AS mean FROM a""")
def bootstrap_auc(spark, sf_dir):
    out = bootstrap_auroc(predictions(spark, sf_dir), "base_id", REPLICATES)
    return out.agg(F.count("auroc").alias("replicates"), F.round(F.percentile("auroc", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("auroc", F.lit(0.975)), 6).alias("high"), F.round(F.avg("auroc"), 6).alias("mean"))  # a row for each replicate


@query(f"""WITH {PREDICTIONS} SELECT family, severity, count(*) AS n, grouping(family, severity) AS level FROM p GROUP BY ROLLUP (family, severity)""")
def case_counts(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.rollup("family", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
