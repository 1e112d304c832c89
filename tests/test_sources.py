"""Sources, sinks and the stream on files made here."""

import io
import json
import os
import tarfile
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from vetlake.operators import fusion as X
from vetlake.sources import files as S
from vetlake.sources import sinks as K
from vetlake.streaming import resume, scorer


def test_scan_status_and_exclusions(spark, tmp_path):
    for name, data in {"d/a.jpg": b"x", "d/b.png": b"", "d/._a.jpg": bytes.fromhex("00051607") + b"z", "d/c.txt": b"t", ".git/e.jpg": b"x", "outputs/f.jpg": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = S.scan(spark, f"file://{tmp_path}")
    (tmp_path / "d/_x").write_bytes(b"")
    (tmp_path / "d/link.jpg").symlink_to(tmp_path / "d/a.jpg")
    (tmp_path / "around").symlink_to(tmp_path)
    assert {r["path"]: r["status"] for r in rows.collect()} == {"d/a.jpg": "ok", "d/b.png": "corrupt", "d/._a.jpg": "auxiliary", "d/_x": "unsupported", "d/c.txt": "unsupported"}
    assert {r["path"]: bytes(r["content"]) for r in S.scan(spark, str(tmp_path), "*.jpg").collect()} == {"d/a.jpg": b"x", "d/._a.jpg": bytes.fromhex("00051607") + b"z"}
    more = spark.createDataFrame([("d/b.png", 0, b""), ("d/._a.jpg", 5, bytes.fromhex("00051607") + b"z"), ("d/._c.jpg", 1, b"z")], "path string, length long, content binary")
    assert [r["status"] for r in S.with_status(more).collect()] == ["corrupt", "auxiliary", "ok"]
    assert [r["root"] for r in S.candidates(rows).collect()] == ["d"]
    top = spark.createDataFrame([("a.ppm",), ("x/b.PGM",), ("y/c.txt",)], "path string")
    assert sorted(r["root"] for r in S.candidates(top).collect()) == ["", "x"]
    assert set(S.EXCLUDED) >= {".pytest_cache", ".pytest-tmp"} and "node_modules" not in S.EXCLUDED


def test_safe_paths(spark):
    df = spark.createDataFrame([("a/b",), ("../x",), ("/etc",), ("a/../b",), ("a..b",)], "path string")
    assert {r["path"] for r in S.safe_paths(df).collect()} == {"a/b", "a..b"}


def test_label_file(spark, tmp_path):
    p = tmp_path / "labels.txt"
    p.write_text("a.jpg 3\nb.jpg 4 validation\n\nc.jpg x\nd.jpg 1 other\na.jpg 5\n")
    got = {(r["name"], r["class_id"], r["split"], r["error"]) for r in S.label_file(spark, str(p)).collect()}
    assert got == {("a.jpg", 3, None, False), ("b.jpg", 4, "val", False), ("c.jpg", None, None, True), ("d.jpg", None, None, True), ("a.jpg", 5, None, False)}
    assert [r["name"] for r in S.label_conflicts(S.label_file(spark, str(p))).collect()] == ["a.jpg"]


def test_csv_and_casts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,name\n0,x\n1, y \n")
    assert [(r[0], r[1]) for r in S.class_map(spark, str(tmp_path / "m.csv")).orderBy("class_id").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "t.csv").write_text("﻿c,l\n3.0,\"['a', 'b']\"\nz,[]\n")
    df = S.csv_text(spark, str(tmp_path / "t.csv"))
    got = df.select(S.integer("c").alias("c"), S.literal_list("l").alias("l")).collect()
    assert [(r["c"], r["l"]) for r in got] == [(3, ["a", "b"]), (None, [])]
    (tmp_path / "o/x").mkdir(parents=True)
    (tmp_path / "o/x/predictions.csv").write_text("base_id\nq\n")
    assert S.csv_history(spark, str(tmp_path / "o")).select("base_id").first()[0] == "q"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/x/1.txt", "one")
        z.writestr("top/../../evil", "no")
    buffer = io.BytesIO(b"two")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("top/2.txt")
        info.size = 3
        t.addfile(info, buffer)
        link = tarfile.TarInfo("top/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    got = {(r["path"], r["status"], bytes(r["content"]) if r["content"] is not None else None) for n in ("a.zip", "b.tar") for r in S.archive(spark, str(tmp_path / n)).collect()}
    assert ("x/1.txt", "ok", b"one") in got and ("2.txt", "ok", b"two") in got
    assert sum(s == "rejected" and c is None for _, s, c in got) == 2
    assert [(r["path"], r["content"], r["status"]) for r in S.archive(spark, str(tmp_path / "a.zip"), "0" * 32).collect()] == [(None, None, "wrong checksum")]


def test_large_archives_are_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, tarfile.open(tmp_path / "b.tar", "w") as t, tarfile.open(tmp_path / "c.tar.gz", "w:gz") as g:
        for k in range(1000):
            body = f"{k} ".encode() * 100
            z.writestr(f"top/{k % 7}/{k}.txt", body)
            for tar in (t, g):
                info = tarfile.TarInfo(f"top/{k % 7}/{k}.txt")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    want = {f"{k % 7}/{k}.txt": f"{k} ".encode() * 100 for k in range(1000)}
    for name, tasks in (("a.zip", 5), ("b.tar", 5), ("c.tar.gz", 1)):
        rows = S.archive(spark, str(tmp_path / name), partition_bytes=60_000)
        assert rows.rdd.getNumPartitions() >= tasks
        assert {r["path"]: bytes(r["content"]) for r in rows.collect()} == want
        assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= (1000 if tasks == 1 else 250)
    (tmp_path / "none").mkdir()
    assert S.scan(spark, str(tmp_path / "none")).count() == 0


def test_write_once_and_claim(spark, tmp_path):
    p = f"file://{tmp_path}/x.txt"
    assert K.write_once(spark, p, "é") is True
    assert K.write_once(spark, p, "é") is False
    with pytest.raises(K.AlreadyWrittenError):
        K.write_once(spark, p, "b")
    K.claim(spark, f"{p}.claim")
    with pytest.raises(K.AlreadyWrittenError):
        K.claim(spark, f"{p}.claim")


def test_table_once(spark, tmp_path):
    df, p = spark.range(10).withColumn("x", F.col("id") % 3), f"file://{tmp_path}/t"
    assert K.table_once(df, p) is True
    assert K.table_once(df.repartition(3).orderBy(F.desc("id")), p) is False
    with pytest.raises(K.AlreadyWrittenError):
        K.table_once(df.where("id > 0"), p)


def test_writers_at_once_leave_one_table(spark, tmp_path):
    """Six writers of two contents at the same time: one writes, equal ones find it, others raise, nothing is left beside it."""
    p, results = f"file://{tmp_path}/t", []

    def write(k):
        try:
            results.append((k % 2, K.table_once(spark.range(1000 + k % 2).repartition(3), p)))
        except K.AlreadyWrittenError:
            results.append((k % 2, "raised"))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for k, r in results if r is True]
    assert len(won) == 1 and len(results) == 6 and spark.read.parquet(p).count() == 1000 + won[0]
    assert all(r is False for k, r in results if k == won[0] and r is not True) and all(r == "raised" for k, r in results if k != won[0])
    assert os.listdir(tmp_path) == ["t"]


def test_failed_writers_leave_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("y"))
    with pytest.raises(Exception, match="no"):
        K.table_once(bad, f"file://{tmp_path}/t")
    assert os.listdir(tmp_path) == []
    none = spark.createDataFrame([], "a long, b array<string>")
    assert K.table_once(none, f"file://{tmp_path}/t") is True and spark.read.parquet(f"file://{tmp_path}/t").schema == none.schema
    assert K.table_once(none, f"file://{tmp_path}/t") is False
    (tmp_path / "other").mkdir()
    (tmp_path / "other/x").write_text("not ours")
    with pytest.raises(K.AlreadyWrittenError):
        K.table_once(none, f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="rename"):
        K.OnceSink({"path": "s3://bucket/x"}).writer(none.schema, False)


def test_claims_at_once(spark, tmp_path):
    p, taken = f"file://{tmp_path}/deep/claim", []

    def claim(k):
        try:
            K.claim(spark, p, str(k))
            taken.append(k)
        except K.AlreadyWrittenError:
            pass

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(taken) == 1 and (tmp_path / "deep/claim").read_text() == str(taken[0]) and os.listdir(tmp_path / "deep") == ["claim"]


def test_strict_json(spark):
    assert json.loads(K.strict_json({"a": 1.5})) == {"a": 1.5}
    with pytest.raises(ValueError):
        K.strict_json({"a": float("nan")})
    good = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert json.loads(K.finite_json(good).first()[0]) == {"a": 1.0, "b": "x"}
    with pytest.raises(Exception, match="not finite"):
        K.finite_json(spark.createDataFrame([(float("inf"),)], "a double")).collect()


def test_probes_are_not_overwritten(spark, tmp_path):
    from vetlake.operators.protocol import save_probe

    one, path = spark.createDataFrame([(0.5, True)], "residual_mae double, finite boolean"), f"file://{tmp_path}/probe.json"
    save_probe(one, path)
    with pytest.raises(K.AlreadyWrittenError):
        save_probe(one, path)
    assert json.loads((tmp_path / "probe.json").read_text()) == {"residual_mae": 0.5, "finite": True}
    with pytest.raises(ValueError):
        save_probe(spark.createDataFrame([(float("nan"),)], "x double"), f"file://{tmp_path}/other.json")
    assert not (tmp_path / "other.json").exists()


def test_freeze(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    got = K.freeze(spark, f"file://{tmp_path}/f", [f"file://{tmp_path}/in.txt"], {"seed": 42}, ("seed",))
    assert len(got["files"]) == 1
    with pytest.raises(ValueError):
        K.freeze(spark, f"file://{tmp_path}/g", [f"file://{tmp_path}/in.txt"], {}, ("seed",))


def test_killed_run_goes_on(spark, tmp_path):
    """A run that dies in its third batch, and one that is stopped: started again, every case is made once, and only finished batches are read."""
    jobs, out, log = (f"{tmp_path}/{n}" for n in ("jobs", "out", "log"))
    cases = [(f"c{k}", k) for k in range(40)] + [(None, -1)]
    spark.createDataFrame(cases + cases[:5], "case_id string, k int").repartition(6).write.parquet(jobs)
    assert resume.finished(spark, out, ["case_id"]) is None and resume.pending(spark, spark.read.parquet(jobs), out, ["case_id"]).count() == 46
    fatal = spark.read.parquet(jobs).where("case_id = 'c17'").select(F.input_file_name()).first()[0]
    assert fatal
    broken = lambda df: df.withColumn("made", F.when(F.col("case_id") == "c17", F.raise_error(F.lit("killed"))).otherwise("x"))
    whole = lambda df: df.withColumn("made", F.lit("x"))
    with pytest.raises(Exception, match="killed"):
        resume.run(spark, jobs, out, log, ["case_id"], broken, files=1)
    done = resume.finished(spark, out, ["case_id"])
    some = 0 if done is None else done.count()
    left = resume.pending(spark, spark.createDataFrame(cases, "case_id string, k int"), out, ["case_id"])
    assert some < 41 and left.count() == 41 - some and left.where("case_id = 'c17'").count() == 1
    assert resume.run(spark, jobs, out, log, ["case_id"], whole, files=1)
    spark.createDataFrame([("c3", 3), ("new", 1)], "case_id string, k int").write.mode("append").parquet(jobs)
    assert resume.run(spark, jobs, out, log, ["case_id"], whole)
    names = [r["case_id"] for r in resume.finished(spark, out, ["case_id"]).collect()]
    assert len(names) == 42 and set(names) == {c for c, _ in cases} | {"new"}
    assert resume.pending(spark, spark.read.parquet(jobs), out, ["case_id"]).count() == 0


def test_stream_scores_like_batch(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("double").alias("a"), F.timestamp_seconds(F.col("id") * 7200).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    state = X.fit(rows, ["a"])
    state.write.parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")
    stream = scorer.events_stream(spark, f"{tmp_path}/in", rows.schema)
    out = scorer.score_stream(stream, state, (1.0,), 0.5, ["a"])
    q = out.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = scorer.score_stream(rows, state, (1.0,), 0.5, ["a"])
    assert sorted(map(str, spark.table("scored").collect())) == sorted(map(str, want.collect()))
    days = scorer.alerts_by_day(scorer.score_stream(rows, state, (1.0,), 0.5, ["a"])).collect()
    assert sum(r["rows"] for r in days) == 40
