"""Validation of a finished run: what was recorded against what the recorded tables give when they are worked out anew."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.robust import finite
from . import fusion, guards
from . import metrics as M

#: How far a recorded number may be from the one worked out anew.
RELATIVE, ABSOLUTE = 1e-5, 1e-8


def close(a: float | None, b: float | None) -> bool:
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= ABSOLUTE + RELATIVE * abs(b)


@dataclass
class Run:
    """What a run left: tables with base_id, group_id, is_anomaly and, where they hold scores, the branches; and its records.

    record: model_hashes, config, weights (variant -> weights), thresholds (variant -> number), metrics (name -> number or None),
    medians and scales (branch -> number), files (path -> sha256).
    """

    parts: dict[str, DataFrame]
    training: DataFrame
    normal_scores: DataFrame
    benchmark: DataFrame
    predictions: DataFrame
    ablations: DataFrame
    record: dict
    main: str = "V3_full"
    quantile: float = 0.99
    keys: tuple[str, ...] = ("base_id", "group_id")
    branches: tuple[str, ...] = fusion.BRANCHES
    current: dict = field(default_factory=dict)


def _none(rows: DataFrame) -> bool:
    return not rows.limit(1).count()


def _disjoint(parts: dict[str, DataFrame], keys) -> bool:
    rows = [df.select(*keys, F.lit(name).alias("part")) for name, df in parts.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionAll(more)
    return _none(guards.shared_keys(every, "part", list(keys)))


def _fused(run: Run, weights) -> Column:
    z = [(F.col(b) - F.lit(float(run.record["medians"][b]))) / F.lit(float(run.record["scales"][b])) for b in run.branches]
    return sum((F.lit(float(w)) * F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)) for w, x in zip(weights, z, strict=True) if w), F.lit(0.0))


def _measured(rows: DataFrame, score: Column, threshold: float) -> dict:
    rows = rows.select(F.col("is_anomaly").alias("y"), score.alias("score"))
    counts = M.confusion(rows, [], F.lit(float(threshold))).select("precision", "recall", "f1", "specificity", "fpr", "balanced_accuracy")
    return counts.first().asDict() | M.areas(rows, []).select("auroc", "auprc").first().asDict()


def _variants(run: Run) -> dict[str, Column]:
    return {name: _fused(run, w) for name, w in run.record["weights"].items()}


def _thresholds(run: Run) -> bool:
    limits = fusion.thresholds(fusion.by_variant(run.normal_scores, _variants(run)), ["variant"], run.quantile).collect()  # a row for each variant
    found = {r["variant"]: r["threshold"] for r in limits}
    return found.keys() == run.record["thresholds"].keys() and all(close(found[v], t) for v, t in run.record["thresholds"].items())


def _ablations(run: Run, predictions: DataFrame) -> bool:
    rows = run.ablations.select("variant", "auroc").collect()  # a row for each variant
    if {r["variant"] for r in rows} != set(run.record["weights"]):
        return True  # told by its own check
    each = fusion.by_variant(predictions.withColumnRenamed("score", "__stored").withColumn("y", F.col("is_anomaly")), _variants(run))
    found = {r["variant"]: r["auroc"] for r in M.rank_auroc(each.select("variant", "y", "score"), ["variant"]).collect()}
    return all(close(found[r["variant"]], r["auroc"]) for r in rows)


def _files(spark: SparkSession, files: dict[str, str]) -> bool:
    """Named files by their contents; one that is not there fails."""
    if not files:
        return True
    try:
        rows = spark.read.format("binaryFile").load(list(files)).select("path", F.sha2("content", 256).alias("sha256")).collect()  # a row for each named file
    except Exception:
        return False
    bare = lambda p: p.split(":", 1)[-1].lstrip("/") if p.startswith("file:") else p
    return {bare(r["path"]): r["sha256"] for r in rows} == {bare(p): h for p, h in files.items()}


def validate(run: Run) -> DataFrame:
    """check, ok: one row for each check; each can fail by itself.

    splits_disjoint, normals_clean, calibration_original, benchmark_subset, benchmark_changed, run_disjoint, models, config, weights,
    thresholds, scores_finite, scores_fused, metrics, variants, ablations, files. Scores that are not finite fail scores_finite and
    are left out of the checks that work scores out anew.
    """
    spark, record = run.predictions.sparkSession, run.record
    usable = run.predictions.where(finite(F.col("score")))
    for b in run.branches:
        usable = usable.where(finite(F.col(b)))
    apart = lambda a, b: F.abs(a - b) > ABSOLUTE + RELATIVE * F.abs(b)
    bad = lambda rows, condition: rows.where(F.coalesce(condition, F.lit(True)))
    every_finite = [finite(F.col(c)) for c in (*run.branches, "score")]
    clean = lambda df: bad(df, F.col("is_anomaly") != 0)
    measured = lambda: _measured(usable, F.col("score"), record["thresholds"].get(run.main, math.nan))
    checks: dict[str, Callable[[], bool]] = {
        "splits_disjoint": lambda: _disjoint(run.parts, run.keys),
        "normals_clean": lambda: all(_none(clean(df)) for df in (*run.parts.values(), run.training, run.normal_scores)),
        "calibration_original": lambda: all(_none(bad(run.parts[p], ~F.col("is_original"))) for p in ("calibration", "test")),
        "benchmark_subset": lambda: _none(run.benchmark.join(run.parts["test"], "base_id", "left_anti")),
        "benchmark_changed": lambda: _none(bad(run.benchmark, (F.col("is_anomaly") != 1) | (F.col("changed_fraction") <= 0))),
        "run_disjoint": lambda: _disjoint({"train": run.training, "calibration": run.normal_scores, "test": run.benchmark}, run.keys),
        "models": lambda: record["model_hashes"] == run.current.get("model_hashes"),
        "config": lambda: record["config"] == run.current.get("config"),
        "weights": lambda: {v: tuple(w) for v, w in record["weights"].items()} == {v: tuple(w) for v, w in run.current.get("weights", fusion.WEIGHTS).items()},
        "thresholds": lambda: _thresholds(run),
        "scores_finite": lambda: _none(bad(run.predictions, ~_all(every_finite))),
        "scores_fused": lambda: _none(bad(usable, apart(_fused(run, record["weights"][run.main]), F.col("score")))),
        "metrics": lambda: all(close(v, record["metrics"].get(k)) for k, v in measured().items()),
        "variants": lambda: {r["variant"] for r in run.ablations.select("variant").distinct().collect()} == set(record["weights"]),
        "ablations": lambda: _ablations(run, usable),
        "files": lambda: _files(spark, record["files"]),
    }
    return spark.createDataFrame([(name, bool(check())) for name, check in checks.items()], "check string, ok boolean")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
