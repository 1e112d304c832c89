"""The two learned scores: held-out accuracy, what they never see, odd rows; and the pipeline's stages together."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetlake.llm import attention_quality as A
from vetlake.llm import toxicity as X
from vetlake.llm.common import Scratch
from vetlake.llm.folds import held_out, training_labels

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def accuracy(rows, labels, label, threshold):
    rows = rows.withColumn("held", held_out(F.col("doc_id"))).join(labels, "doc_id").where("held").collect()
    return np.mean([(r["score"] >= threshold) == r[label] for r in rows]), rows


def test_folds(spark):
    ids = [0, 1, 2, 17, 123456789, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out(F.col("doc_id"))).collect()
    assert [r[0] for r in got] == [i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_training_labels_are_bounded_and_clean(spark):
    rows = [(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (5, 7), (7, 0), (7, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r["doc_id"]: r["label"] for r in training_labels(labels, "quality", 1000).collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in got) and got[7] == 1 and None not in got
    assert training_labels(labels, "quality", 10).count() == 10


@tables
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    share, _ = accuracy(A.score(docs, labels), labels, "quality", 0.3)
    assert share > 0.95


def toxic_corpus(n=900):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        own = rng.choice(words, rng.integers(20, 200)).tolist()
        if toxic:
            for _ in range(max(2, len(own) // 40)):
                own.insert(int(rng.integers(0, len(own))), f"rude{rng.integers(0, 12)}")
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    share, rows = accuracy(X.score(d, n), n, "toxic", 0.5)
    assert share > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    kept = {r["doc_id"] for r in X.drop_toxic(d, n).collect()}
    assert sum(i in kept for i, t, _ in labels if t) < 0.05 * n.count() and sum(i not in kept for i, t, _ in labels if not t) < 0.02 * n.count()


def test_held_out_labels_change_nothing(spark):
    docs, labels = toxic_corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    for module, label in ((X, "toxic"), (A, "toxic")):
        one, two = ({r["doc_id"]: r["score"] for r in module.score(d, spark.createDataFrame(x, "doc_id long, toxic int, quality int"), label).collect()} for x in (labels, flip))
        assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)


@pytest.mark.parametrize("module", [A, X])
def test_scores_of_odd_rows(spark, odd_docs, no_docs, module):
    docs, labels = toxic_corpus(200)
    known = spark.createDataFrame([*labels, (None, 1, 1), (6, None, None)], "doc_id long, toxic int, quality int")
    more = spark.createDataFrame([(i + 1000, t) for i, t in docs], "doc_id long, text string")
    more_labels = spark.createDataFrame([(i + 1000, t, q) for i, t, q in labels], "doc_id long, toxic int, quality int").unionAll(known)
    rows = module.score(odd_docs.select("doc_id", "text", "label", "score").unionByName(more, allowMissingColumns=True), more_labels, "toxic").collect()
    assert len(rows) == odd_docs.count() + len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(no_docs, known, "toxic").count() == 0
    none = module.score(odd_docs, known.where("false"), "toxic").collect()
    assert len(none) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in none)


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, counts, y = rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    model = A.Model(np.zeros(5), np.ones(5))
    weight = np.ones(3)

    def loss():
        p = model.forward(x, counts)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    out, kept = model.forward(x, counts)
    grads = model.gradients(y, out, kept, weight)
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for i in range(min(4, len(flat))):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def plain_models(docs, labels, discount=X.DISCOUNT):
    """Both classes' models by the book: [(p(word), p(word after before))] for toxic and ordinary, and the vocabulary."""
    before = {}
    for _, text in docs:
        for a, b in zip(["", *text.split()], text.split()):
            before.setdefault(b, set()).add(a)
    whole = sum(map(len, before.values())) + len(before)
    shared = lambda w: (len(before[w]) + 1) / whole if w in before else 1 / whole
    out = []
    for c in (1, 0):
        pairs = Counter((a, b) for i, t in docs if labels.get(i) == c for a, b in zip(["", *t.split()], t.split()))
        ends, after = Counter(b for _, b in pairs), Counter()
        kept = Counter()
        for (a, _), n in pairs.items():
            after[a] += n
            kept[a] += max(n - discount, 0)
        total = sum(ends.values())
        back = sum(min(n, discount) for n in ends.values()) / total

        def word(w, ends=ends, total=total, back=back):
            return max(ends[w] - discount, 0) / total + back * shared(w)

        def pair(a, b, pairs=pairs, after=after, kept=kept, word=word):
            return max(pairs[a, b] - discount, 0) / after[a] + (1 - kept[a] / after[a]) * word(b) if after[a] else word(b)

        out.append((word, pair))
    return out, sorted(before)


def test_models_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(25)], rng.integers(1, 60), p=(q := rng.dirichlet(np.ones(25) / 3)))) + (" rude w1 rude w2" if i % 3 == 0 else "") + f" rare{i}") for i in range(80)]
    labels = [(i, int(i % 3 == 0)) for i, _ in docs]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    used = training_labels(known, "toxic", X.LABELLED).withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).where("not curve")
    (toxic, ordinary), vocabulary = plain_models(docs, {r["doc_id"]: r["label"] for r in used.collect()})
    for word, pair in (toxic, ordinary):
        assert sum(map(word, vocabulary)) == pytest.approx(1, abs=1e-9)
        assert all(sum(pair(a, b) for b in vocabulary) == pytest.approx(1, abs=1e-9) for a in vocabulary)
    model, _ = X.models(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), known, "toxic", X.LABELLED, Scratch(spark, "test"))
    for _, text in [*docs, (None, "w1 unknown w2 w2 other"), (None, "")]:
        words = text.split()
        _, _, hashes, first = next(X._hashed(X.pa.array([text])), (0, 1, np.zeros(0, np.uint64), np.zeros(2, np.int64)))
        alone, both = model.ratios(hashes, first, (0.0, 1.0))
        assert alone == pytest.approx([np.log(toxic[0](w) / ordinary[0](w)) for w in words], abs=1e-9)
        want = [np.log(toxic[1](a, b) / ordinary[1](a, b)) if a else np.log(toxic[0](b) / ordinary[0](b)) for a, b in zip(["", *words], words)]
        assert both == pytest.approx(want, abs=1e-6)
        mean = np.mean(np.log(1 - 0.05 + 0.05 * np.exp(want))) if words else 0.0
        assert model.evidence(hashes, first, (0.05,), (1.0,))[0, 0] == pytest.approx(mean, abs=1e-6)


def test_chosen_curve_is_the_likeliest():
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.3).astype(float)
    seen = rng.normal(size=(400, len(X.SHARES) * len(X.WEIGHTS) + 1))
    seen[:, 6] += 3 * y
    share, weight, *line = X.choose(seen, y)
    assert (weight, share) == [(w, s) for w in X.WEIGHTS for s in X.SHARES][6] and line[0] > 0
    assert np.mean((seen[:, [6, -1]] @ line[:2] + line[2] >= 0) == y) > 0.85


@tables
def test_pipeline_runs_its_stages(spark, tmp_path):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]
    out = C.run(spark, "/root/testdata/sf0.001")
    pieces = out.collect()
    assert pieces and set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs_after = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs_after.columns == docs.columns, name
        path = f"file://{tmp_path}/{name}"
        docs_after.write.parquet(path)
        docs = spark.read.parquet(path)
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_backoff_counts_are_of_all_documents(spark):
    docs, labels = toxic_corpus(60)
    docs += [(1000 + i, f"p{i} w1 p{i} w1 q{i}") for i in range(2000)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model, _ = X.models(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), known, "toxic", X.LABELLED, Scratch(spark, "test"))
    used = training_labels(known, "toxic", X.LABELLED).withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).where("not curve")
    (toxic, ordinary), _ = plain_models(docs, {r["doc_id"]: r["label"] for r in used.collect()})
    _, _, hashes, first = next(X._hashed(X.pa.array(["w1 w2 w3 rude1"])))
    assert model.ratios(hashes, first, (0.0,))[0] == pytest.approx([np.log(toxic[0](w) / ordinary[0](w)) for w in ("w1", "w2", "w3", "rude1")], abs=1e-9)


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_packed_pairs_are_counted_exactly(most):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, rng.integers(0, 90)) % 400) for _ in range(300)] + [None, ""]
    texts += [" ".join(f"u{i} hot" for i in range(70_000))]  # one word with more pairs than an entry counts
    before = {}
    for t in texts:
        for a, b in zip(["", *(t or "").split()], (t or "").split()):
            before.setdefault(b, set()).add(a)
    for buckets in (16, 50):
        rows = [r for batch in X._continuations(buckets, most)([pa.record_batch([pa.array(texts)], ["text"])]) for r in batch.to_pylist()]
        rows.sort(key=lambda r: r["bucket"])
        got = Counter()
        for batch in X._counted([pa.RecordBatch.from_pylist(rows[i : i + 7], pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])) for i in range(0, len(rows), 7)]):
            for r in batch.to_pylist():
                got[r["word"]] += r["n"]
        words = sorted(before)
        _, _, hashes, _ = next(X._hashed(pa.array([" ".join(words)])))
        assert got == {int(h): len(before[w]) for w, h in zip(words, X._short(hashes))}
