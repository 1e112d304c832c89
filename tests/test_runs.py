"""Folder conventions, validation of recorded runs, fingerprints, case folding."""

import hashlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetlake.functions import keys as K
from vetlake.operators import folders as D
from vetlake.operators import fusion as X
from vetlake.operators import guards as V
from vetlake.operators import validation as R


def test_casefold_is_unicode_folding(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)] + ["\u0131", "\u03c3\u03c2", "stra\u00dfe"]
    cherokee = lambda c: 0x13A0 <= ord(c[0]) <= 0x13FF or 0xAB70 <= ord(c[0]) <= 0xABBF
    rows = spark.createDataFrame([(c,) for c in chars if not cherokee(c)], "c string").select("c", K.casefold(F.col("c")).alias("f")).collect()
    # the JVM's tables may be of another version of Unicode than Python's
    assert [r["c"] for r in rows if r["f"] != r["c"].casefold() and r["c"].upper().lower() == r["c"].casefold()] == []
    assert {r["c"]: r["f"] for r in rows}["stra\u00dfe"] == "strasse"


def test_folder_facts(spark):
    df = spark.createDataFrame([("Train/NORMAL/a_r90.jpg",), ("test/anomaly_real/x/b.jpg",), ("training/validation/normal/anomaly_real/c.jpg",), ("valid/val/d.jpg",), ("e.jpg",), (None,)], "path string")
    got = {r["path"]: (r["label"], r["original_split"], r["class_name"], r["base_id"], r["folder_flags"]) for r in D.folder_facts(df, anomaly=("anomaly_real",)).collect()}
    assert got["Train/NORMAL/a_r90.jpg"] == ("normal", "train", "normal", "a", [])
    assert got["test/anomaly_real/x/b.jpg"] == ("anomaly", "test", "anomaly_real/x", "b", [])
    assert got["training/validation/normal/anomaly_real/c.jpg"] == ("unknown", "unknown", "normal/anomaly_real", "c", ["conflicting_folder_labels", "conflicting_folder_splits"])
    assert got["valid/val/d.jpg"] == ("unknown", "val", "", "d", []) and got["e.jpg"] == ("unknown", "unknown", "", "e", [])
    assert got[None] == (None, None, None, None, [])


def test_folder_splits(spark, tmp_path):
    for k in range(60):
        for folder in ("train/normal", "test/normal", "test/anomaly_real", "train/normal/deeper", "other"):
            p = tmp_path / folder / f"f{k}.jpg"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x")
    (tmp_path / "train/normal/notes.txt").write_text("no")
    rows = D.folder_splits(spark, str(tmp_path), "survey", calibration=0.25).collect()
    n = {p: sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}}
    assert n["train_normal"] == n["test_clean"] == n["test_anomaly"] == 60 and 5 < n["calibration_normal"] < 30
    assert {(r["part"], r["label"], r["is_anomaly"]) for r in rows} == {("train_normal", "normal", 0), ("calibration_normal", "normal", 0), ("test_clean", "normal", 0), ("test_anomaly", "anomaly", 1)}
    assert all(r["base_id"] == r["source_id"] == r["group_id"] == r["split_group_id"] == r["path"].split("/")[-1][:-4] and r["origin"] == "survey" for r in rows)


def test_fingerprint_is_of_the_rows(spark, monkeypatch):
    hashes = [hashlib.sha256(str(k % 350).encode()).hexdigest() for k in range(400)]
    df = spark.createDataFrame([("a" if k % 2 else None, h) for k, h in enumerate(hashes)], "k string, h string")
    one = {r["k"]: r["digest"] for r in V.fingerprint(df, ["k"], "h").collect()}
    assert one == {r["k"]: r["digest"] for r in V.fingerprint(df.repartition(7).orderBy("h"), ["k"], "h").collect()} and len(one) == 2
    less = {r["k"]: r["digest"] for r in V.fingerprint(df.where(F.col("h") != hashes[0]), ["k"], "h").collect()}
    assert less[None] != one[None] and less["a"] == one["a"]

    def plain(own, digits):
        level = {}
        for h in sorted(own):
            level.setdefault(h[:digits], []).append(h)
        level = {p: hashlib.sha256("\n".join(v).encode()).hexdigest() for p, v in level.items()}
        for d in range(digits - 1, 2, -1):
            above = {}
            for p in sorted(level):
                above.setdefault(p[:d], []).append(level[p])
            level = {p: hashlib.sha256("\n".join(v).encode()).hexdigest() for p, v in above.items()}
        return hashlib.sha256("\n".join(level[p] for p in sorted(level)).encode()).hexdigest()

    own = [h for k, h in enumerate(hashes) if k % 2]
    assert one["a"] == plain(own, 3)
    monkeypatch.setattr(V, "HASHES", 0.001)
    assert {r["k"]: r["digest"] for r in V.fingerprint(df, ["k"], "h").collect()}["a"] == plain(own, 5)


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """A run whose records are right."""
    rng, folder = np.random.default_rng(51), tmp_path_factory.mktemp("run")
    b = ", ".join(f"{x} double" for x in X.BRANCHES)
    ids = lambda lo, n: [(f"b{k}", f"g{k}") for k in range(lo, lo + n)]
    part = lambda lo, n: spark.createDataFrame([(*i, 0, True) for i in ids(lo, n)], "base_id string, group_id string, is_anomaly int, is_original boolean")
    scored = lambda rows: spark.createDataFrame([(*i, int(y), *(rng.random(4) + 0.4 * y).tolist()) for i, y in rows], f"base_id string, group_id string, is_anomaly int, {b}").persist()
    parts = {"train": part(0, 20), "calibration": part(20, 40), "test": part(60, 30)}
    normal = scored([(i, 0) for i in ids(20, 40)])
    predictions = scored([(i, k % 3 == 0) for k, i in enumerate(ids(60, 30))])
    state = X.fit(normal).first()
    record = {"model_hashes": {"m": "1"}, "config": {"seed": 42}, "weights": dict(X.WEIGHTS), "medians": {x: state[f"median_{x}"] for x in X.BRANCHES}, "scales": {x: state[f"scale_{x}"] for x in X.BRANCHES}, "thresholds": {}, "metrics": {}, "files": {}}
    run = R.Run(parts, part(0, 20), normal, spark.createDataFrame([(*i, 1, 0.1) for i in ids(60, 30)], "base_id string, group_id string, is_anomaly int, changed_fraction double"), predictions, None, record, current={"model_hashes": {"m": "1"}, "config": {"seed": 42}})
    limits = X.thresholds(X.by_variant(normal, R._variants(run)), ["variant"], 0.99).collect()
    record["thresholds"] = {r["variant"]: r["threshold"] for r in limits}
    run.predictions = predictions.withColumn("score", R._fused(run, X.WEIGHTS["V3_full"]))
    record["metrics"] = R._measured(run.predictions, F.col("score"), record["thresholds"]["V3_full"])
    each = X.by_variant(predictions.withColumn("y", F.col("is_anomaly")), R._variants(run))
    run.ablations = spark.createDataFrame([(r["variant"], r["auroc"]) for r in R.M.rank_auroc(each, ["variant"]).collect()], "variant string, auroc double")
    (folder / "audit.csv").write_text("rows")
    record["files"] = {f"file://{folder}/audit.csv": hashlib.sha256(b"rows").hexdigest()}
    return run


def failed(run):
    return {r["check"] for r in R.validate(run).collect() if not r["ok"]}


def test_right_records_are_valid(recorded):
    rows = R.validate(recorded).collect()
    assert len(rows) == 16 and all(r["ok"] for r in rows)


def changes():
    """check -> what makes it fail, and nothing else: one row or one record."""
    from dataclasses import replace

    def record(**new):
        return lambda run: replace(run, record=run.record | new(run.record) if callable(new) else run.record | {k: f(run.record[k]) for k, f in new.items()})

    def table(name, column, value, where):
        return lambda run: replace(run, **{name: getattr(run, name).withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))})

    def part(name, f):
        return lambda run: replace(run, parts=run.parts | {name: f(run.parts[name])})

    def set_value(column, value, where):
        return lambda df: df.withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))

    return {
        "splits_disjoint": part("train", set_value("group_id", F.lit("g25"), "base_id = 'b3'")),
        "normals_clean": table("training", "is_anomaly", F.lit(1), "base_id = 'b3'"),
        "calibration_original": part("calibration", set_value("is_original", F.lit(None).cast("boolean"), "base_id = 'b30'")),
        "benchmark_subset": table("benchmark", "base_id", F.lit("strange"), "base_id = 'b61'"),
        "benchmark_changed": table("benchmark", "changed_fraction", F.lit(0.0), "base_id = 'b61'"),
        "run_disjoint": table("training", "group_id", F.lit("g61"), "base_id = 'b3'"),
        "models": record(model_hashes=lambda h: {"m": "2"}),
        "config": record(config=lambda c: c | {"seed": 43}),
        "weights": lambda run: replace(run, current=run.current | {"weights": X.WEIGHTS | {"equal": (0.25, 0.25, 0.25, 0.26)}}),
        "thresholds": record(thresholds=lambda t: t | {"equal": t["equal"] + 0.01}),
        "scores_finite": lambda run: replace(run, predictions=run.predictions.unionAll(run.predictions.limit(1).withColumn("score", F.lit(float("nan"))))),
        "scores_fused": lambda run: replace(run, predictions=run.predictions.withColumn("score", F.when(F.col("base_id") == "b60", F.col("score") * 1.001).otherwise(F.col("score")))),
        "metrics": record(metrics=lambda m: m | {"f1": None}),
        "variants": lambda run: replace(run, ablations=run.ablations.where("variant <> 'equal'")),
        "ablations": lambda run: replace(run, ablations=run.ablations.withColumn("auroc", F.col("auroc") + F.when(F.col("variant") == "equal", 0.01).otherwise(0.0))),
        "files": record(files=lambda f: dict.fromkeys(f, "0" * 64)),
    }


@pytest.mark.parametrize("check", ["splits_disjoint", "normals_clean", "calibration_original", "benchmark_subset", "benchmark_changed", "run_disjoint", "models", "config", "weights", "thresholds", "scores_finite", "scores_fused", "metrics", "variants", "ablations", "files"])
def test_each_check_fails_by_itself(recorded, check):
    assert failed(changes()[check](recorded)) == {check}
