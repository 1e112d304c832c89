"""Detection metrics: tie-correct curves and areas, confusion counts, slices, pairs, prevalence.

Scored rows have `score` (double), `y` (1 anomaly, 0 normal) and key columns that name the slice or variant. Rows with a null
score or label are left out of curves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import prefix_sums


def _sliced(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Each anomaly once for every dimension that has a value: dimension, slice."""
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dimensions))
    return rows.where("y = 1").select("*", F.inline(each)).where("slice is not null")


def slice_auroc(rows: DataFrame, dimensions: list[str], keys: list[str] = ()) -> DataFrame:
    """keys, dimension, slice, positives, negatives, auroc: the anomalies of each value of each dimension against all normal rows of their keys.

    Normals are not copied for slices: how many score below and at each score is summed once, and every slice's anomalies look
    their scores up there. Slices whose anomalies have no score have a null auroc. Slices are strings.
    """
    keys = list(keys)
    blocks = rows.where("score is not null and y is not null").groupBy(*keys, "score").agg(F.sum(1 - F.col("y")).alias("neg"))
    table = prefix_sums(blocks, keys, "score", ["neg"])
    total = rows.where("score is not null and y = 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("negatives"))
    own = _sliced(rows, dimensions).groupBy(*keys, "dimension", "slice", "score").agg(F.count("score").alias("pos"))
    beaten = F.col("pos") * (F.col("before_neg") + F.lit(0.5) * F.col("neg"))
    sums = own.join(table, [*keys, "score"], "left").groupBy(*keys, "dimension", "slice").agg(F.sum("pos").alias("positives"), F.sum(beaten).alias("beaten"))
    sums = sums.join(total, keys, "left") if keys else sums.crossJoin(F.broadcast(total))  # one row without keys
    pairs = F.nullif((F.col("positives") * F.col("negatives")).cast("double"), F.lit(0.0))
    return sums.select(*keys, "dimension", "slice", "positives", F.coalesce("negatives", F.lit(0)).alias("negatives"), (F.col("beaten") / pairs).alias("auroc"))


def slice_confusion(rows: DataFrame, dimensions: list[str], threshold: Column) -> DataFrame:
    """dimension, slice and the counts and rates of `confusion`, each slice's anomalies against all normal rows, which are counted once."""
    flagged = F.col("score") > threshold
    normal = rows.where("y = 0").agg(F.count_if(flagged).alias("fp"), F.count_if(~flagged).alias("tn"))
    own = _sliced(rows, dimensions).groupBy("dimension", "slice").agg(F.count_if(flagged).alias("tp"), F.count_if(~flagged).alias("fn"))
    return _rates(own.crossJoin(F.broadcast(normal)))  # one row


def score_blocks(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Anomalies and normals (pos, neg) of each distinct score: ties are one block."""
    w = F.col(weight) if weight else F.lit(1)
    rows = rows.where("score is not null and y is not null")
    return rows.groupBy(*keys, "score").agg(F.sum(F.col("y") * w).cast("long").alias("pos"), F.sum((1 - F.col("y")) * w).cast("long").alias("neg"))


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ROC and precision-recall points from the highest score down: threshold, tp, fp, tpr, fpr, precision, and the points before."""
    blocks = score_blocks(rows, keys)
    sums = prefix_sums(blocks, keys, "score", ["pos", "neg"], descending=True)
    total = blocks.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    out = sums.join(total, keys) if keys else sums.crossJoin(F.broadcast(total))  # one row without keys
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = out.withColumns({"tp": F.col("before_pos") + F.col("pos"), "fp": F.col("before_neg") + F.col("neg")})
    return out.withColumns(
        {
            "threshold": F.col("score"),
            "tpr": part("tp", "positives"),
            "fpr": part("fp", "negatives"),
            "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
            "tpr_before": part("before_pos", "positives"),
            "fpr_before": part("before_neg", "negatives"),
        }
    )


def areas(rows: DataFrame, keys: list[str]) -> DataFrame:
    """positives, negatives, auroc by trapezoids and auprc by steps; null with one class only."""
    points = curve(rows, keys)
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return points.groupBy(*keys).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.when(both, F.sum((F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2)).alias("auroc"),
        F.when(both, F.sum((F.col("tpr") - F.col("tpr_before")) * F.col("precision"))).alias("auprc"),
    )


def rank_auroc(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """positives, negatives and the Mann-Whitney auroc, ties half; null with one class only."""
    blocks = prefix_sums(score_blocks(rows, keys, weight), keys, "score", ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("before_neg") + F.lit(0.5) * F.col("neg")))
    return blocks.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (pairs / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auroc"),
    )


def confusion(rows: DataFrame, keys: list[str], threshold: Column, strict_zero: bool = False) -> DataFrame:
    """tp, fp, tn, fn at a strict threshold and the rates from them.

    precision, recall and f1 are 0 where undefined, specificity, fpr and balanced_accuracy null; with strict_zero so is recall.
    """
    flagged, y = F.col("score") > threshold, F.col("y") == 1
    n = lambda c: F.count_if(c)
    return _rates(rows.groupBy(*keys).agg(n(flagged & y).alias("tp"), n(flagged & ~y).alias("fp"), n(~flagged & ~y).alias("tn"), n(~flagged & y).alias("fn")), strict_zero)


def _rates(out: DataFrame, strict_zero: bool = False) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b, other: F.coalesce(a / F.nullif(b, F.lit(0)), other)
    nothing, zero = F.lit(None).cast("double"), F.lit(0.0)
    out = out.withColumns({"precision": ratio(tp, tp + fp, zero), "recall": ratio(tp, tp + fn, nothing if strict_zero else zero), "f1": ratio(2 * tp, 2 * tp + fp + fn, zero), "specificity": ratio(tn, tn + fp, nothing), "fpr": ratio(fp, tn + fp, nothing)})
    return out.withColumn("balanced_accuracy", F.when(tp + fn > 0, (F.col("recall") + F.col("specificity")) / 2))


def paired_share(rows: DataFrame, base: str, order: str, keys: list[str] = ()) -> DataFrame:
    """How many anomalies score above the last normal row of their base, by `order`: paired_n and the share."""
    clean = rows.where("y = 0").groupBy(base).agg(F.max_by("score", order).alias("clean"))
    pairs = rows.where("y = 1").join(clean, base)
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("paired_n"), F.avg((F.col("score") > F.col("clean")).cast("double")).alias("paired_anomaly_gt_clean"))


def at_prevalence(rows: DataFrame, keys: list[str], threshold: float, prevalences: list[float]) -> DataFrame:
    """What a detector would do at assumed shares of anomalies: expected precision, alerts per 1000, reweighted average precision."""
    spark = rows.sparkSession
    shares = spark.createDataFrame([(p,) for p in prevalences], "prevalence double")
    points = curve(rows, keys).crossJoin(F.broadcast(shares))
    pi = F.col("prevalence")
    hit, false = pi * F.col("tpr"), (1 - pi) * F.col("fpr")
    ap = points.groupBy(*keys, "prevalence").agg(F.sum((F.col("tpr") - F.col("tpr_before")) * hit / F.nullif(hit + false, F.lit(0.0))).alias("reweighted_average_precision"))
    rates = confusion(rows, keys, F.lit(threshold)).select(*keys, F.col("recall").alias("tpr"), "fpr").crossJoin(F.broadcast(shares))
    rates = rates.select(*keys, "prevalence", "tpr", "fpr", F.coalesce(hit / F.nullif(hit + false, F.lit(0.0)), F.lit(0.0)).alias("expected_precision"), (1000 * false).alias("false_alerts_per_1000"), (1000 * hit).alias("true_alerts_per_1000"))
    return rates.join(ap, [*keys, "prevalence"])
