"""Near-duplicates, decontamination and repeated passages against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetlake.llm import decontaminate as D
from vetlake.llm import jaccard_join as J
from vetlake.llm import substring_dedup as S
from vetlake.llm.words import ALNUM_WORDS, WHITE_WORDS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text):
    w = white(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(docs, num=80, den=100):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (p, (_, a)), (q, (_, b)) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if a and b and den * both >= num * (len(a) + len(b) - both):
            x, y = sorted((find(p), find(q)))
            root[y] = x
    out = []
    for p, (i, s) in enumerate(sets):
        own = [sets[q][0] for q in range(len(sets)) if find(q) == find(p) and sets[q][0] is not None]
        out.append((i, len(s), (min(own) if own else None) if s else i))
    return sorted(out, key=str)


def edited(rng, words, share):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def corpus(seed, n=60):
    """Families of edited copies at many distances, common passages, short texts and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    common = rng.choices(vocabulary, k=40)
    docs = []
    for f in range(6):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 25, 60, 150]))
        for _ in range(n // 6):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0, 0.01, 0.02, 0.04, 0.08]))))
    docs += [" ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 5, 9, 50])) + common) for _ in range(n // 3)]
    docs += ["", None, "one", "one", "ONE two", "one two"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = J.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(docs)


def test_jaccard_join_of_crowded_families(spark, monkeypatch):
    monkeypatch.setattr(J, "CROWD", 3)
    monkeypatch.setattr(J, "BLOCK_SETS", 8)
    docs = corpus(7, 90)
    got = J.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(docs)


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    none = np.zeros(0, np.uint64)
    for _ in range(150):
        n = int(rng.choice([1, 2, 4, 5, 7, 9, 11, 17, 22, 23, 40, 90, 200]))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 60, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            common = len(np.intersect1d(J.signatures(a, none, 80, 100)[0], J.signatures(b, none, 80, 100)[0]))
            assert common >= 1
            if min(len(a), len(b)) > 22:
                assert common > min(J.spare(len(a)), J.spare(len(b)))


def test_jaccard_join_of_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = J.ngram_jaccard_join(odd_docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(docs)
    assert J.ngram_jaccard_join(no_docs).count() == 0
    kept = J.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_jaccard_join_without_ids(spark):
    docs = [(None if i % 3 else i, t) for i, t in corpus(5)]
    got = J.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(docs)


def overlaps(docs, items, window=13):
    out = []
    windows = set()
    for name, text in items:
        w = alnum(text)
        n = min(window, len(w))
        windows |= {(name, tuple(w[i : i + n])) for i in range(len(w) - n + 1)} if n else set()
    for i, text in docs:
        w, hit, own = alnum(text), set(), set()
        for name, g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    own |= {str(name)} if name is not None else set()
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(own), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(rows):
    rows = rows.select("doc_id", "n_words", D.n_hit().alias("n_hit"), F.size("items").alias("n_items"), "items")
    rows = rows.withColumn("c", D.contaminated(F.col("n_hit"), F.col("n_words")))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], D.items_digest(r["items"]), r["c"]) for r in rows.collect()), key=str)


def contaminated_corpus():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 13, 14, 30, 90])))) for i in range(20)] + [(20, ""), (21, None), (None, "null item words here"), (3, "again three"), (22, "Same WINDOW, twice; same window twice")]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            own = alnum(rng.choice(items)[1])
            at, a = rng.randint(0, len(w)), rng.randint(0, max(0, len(own) - 5))
            w[at:at] = own[a : a + rng.choice([5, 13, 20, 100])]
        docs.append((i, ", ".join(w)))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_overlaps_equal_brute_force(spark, block):
    docs, items = contaminated_corpus()
    got = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert found(got) == overlaps(docs, items)


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 20)
    docs, items = contaminated_corpus()
    got = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == overlaps(docs, items)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_overlaps_of_odd_rows(spark, odd_docs, no_docs, block):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, docs[5][1]), (2, "one"), (3, ""), (4, None), (1, docs[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(D.find_overlaps(odd_docs, bench, block_words=block)) == overlaps(docs, items)
    assert D.find_overlaps(no_docs, bench).count() == 0
    none = bench.where("false")
    assert found(D.find_overlaps(odd_docs, none)) == overlaps(docs, [])
    kept = D.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_, c in overlaps(docs, items) if not c)


def test_word_finders():
    texts = ["Ab c", "", "É-x\x0b1", "a", "\x00b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for finder, plain in ((WHITE_WORDS, white), (ALNUM_WORDS, alnum)):
        starts, ends, hashes, first = finder(data, offsets)
        raw = data.tobytes()
        for i, t in enumerate(texts):
            assert [raw[s:e].decode().translate(LOWER) for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == plain(t)
        same = {}
        for s, e, h in zip(starts, ends, hashes):
            assert same.setdefault(raw[s:e].decode().translate(LOWER), h) == h
        assert len(set(same.values())) == len(same)


def planted():
    """Passages of 60 words, exact and edited, in some documents; the others share nothing."""
    rng = random.Random(11)
    fresh = itertools.count()
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    exact, fuzzy, short = new(60), new(80), new(40)
    docs, want = {}, {}
    for i in range(30):
        parts, own = new(rng.randint(20, 90)), set()
        if i % 3 == 0:
            parts += exact + new(30)
            own.add("exact")
        if i % 5 == 0:
            copy = [f"e{next(fresh)}" if j % 20 == 19 else w for j, w in enumerate(fuzzy)]
            if i:
                del copy[40]
            parts += copy + new(10)
            own.add("fuzzy")
        if i % 7 == 0:
            parts += short
        docs[i], want[i] = " ".join(parts), own
    return docs, want, exact, fuzzy


def test_planted_passages_are_found(spark):
    docs, want, exact, fuzzy = planted()
    rows = S.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    seen = {i: set() for i in docs}
    for r in rows:
        assert r["a"] < r["b"] and r["n_equal"] >= 0.8 * r["n_columns"] - 1e-6
        for side in "ab":
            words = docs[r[side]].split(" ")[r[f"begin_{side}"] : r[f"end_{side}"]]
            assert len(words) >= 50
            seen[r[side]].add("exact" if set(words) & set(exact) else "fuzzy" if set(words) & set(fuzzy) else "other")
    assert seen == want


def test_cut_leaves_the_first_of_each_passage(spark):
    docs, want, exact, _ = planted()
    df = spark.createDataFrame([(i, t, len(t), 5) for i, t in docs.items()], "doc_id long, text string, n_chars long, spans int")
    out = S.cut_repeats(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        assert r["n_chars"] == len(r["text"]) and r["spans"] == 5
        assert (set(exact) <= set(r["text"].split())) == (i == 0)
        if not want[i]:
            assert r["text"] == docs[i]
        own = [w for w in docs[i].split() if docs[i].split().count(w) == 1 and sum(w in t.split() for t in docs.values()) == 1 and not w.startswith("e")]
        lost = set(own) - set(r["text"].split())
        assert len(lost) <= 12  # a stretch may take a few neighbouring words along


def test_whole_copies_and_odd_rows(spark, odd_docs, no_docs):
    rows = S.repeated_passages(odd_docs).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(6, 7)}
    assert all(r["end_b"] - r["begin_b"] == 80 for r in rows)
    assert S.repeated_passages(no_docs).count() == 0
    kept = S.cut_repeats(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "10", "None", "None"])
    assert S.cut_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_chain_equals_quadratic_search(seed):
    rng = np.random.default_rng(seed)
    n = 12
    segs = np.stack((rng.integers(0, 120, n), np.sort(rng.integers(0, 120, n)), rng.integers(5, 20, n)), 1)
    segs = segs[np.lexsort((segs[:, 0], segs[:, 1]))]
    k = 5
    score = [float(s) for s in segs[:, 2]]
    for j in range(n):
        for i in range(n):
            ea, eb = segs[i, 0] + segs[i, 2] - k + 1, segs[i, 1] + segs[i, 2] - k + 1
            if ea <= segs[j, 0] and eb <= segs[j, 1] and i < j:
                score[j] = max(score[j], segs[j, 2] + score[i] - S.GAP_COST * (segs[j, 0] - ea + segs[j, 1] - eb))
    best = S.chain(segs, k)[0]
    got = float(segs[best[0], 2])
    for i, j in zip(best, best[1:]):
        ea, eb = segs[i, 0] + segs[i, 2] - k + 1, segs[i, 1] + segs[i, 2] - k + 1
        assert ea <= segs[j, 0] and eb <= segs[j, 1]
        got += segs[j, 2] - S.GAP_COST * (segs[j, 0] - ea + segs[j, 1] - eb)
    assert got == pytest.approx(max(score))


def test_stretches_have_their_share():
    rng = np.random.default_rng(5)
    for _ in range(50):
        eq = (rng.random(300) < np.repeat(rng.choice([0.2, 0.95], 6), 50)).astype(int)
        cols = np.stack((np.arange(300), np.arange(300), eq), 1)
        for lo, hi in S.stretches(cols, 50, 0.8):
            assert hi - lo >= 50 and eq[lo:hi].mean() >= 0.8 - 1e-9


def test_alignments_without_gaps_have_the_stretches_that_each_has_by_itself():
    rng = np.random.default_rng(11)
    sizes = np.concatenate(([0, 1, 49, 50, 51], rng.integers(0, 900, 120)))
    equal = [rng.random(n) < np.repeat(rng.choice([0.1, 0.75, 0.81, 1.0], n // 60 + 1), 60)[:n] for n in sizes]
    first = np.concatenate(([0], np.cumsum(sizes)))
    found = set(zip(*(c.tolist() for c in S.plain_stretches(np.concatenate(equal), first, 50, 0.8)), strict=True))
    want = set()
    for i, own in enumerate(equal):
        cols = np.stack((np.arange(len(own)), np.arange(len(own)), own.astype(np.int64)), 1)
        want |= {(i, int(first[i]) + lo, int(first[i]) + hi) for lo, hi in S.stretches(cols, 50, 0.8)}
    assert found == want and len(want) > 50
    assert [len(c) for c in S.plain_stretches(np.zeros(0, bool), np.zeros(1, np.int64), 50, 0.8)] == [0, 0, 0]


def test_matches_of_many_pairs_merge_as_those_of_each_pair():
    rng = np.random.default_rng(12)
    pair = np.sort(rng.integers(0, 40, 800))
    x, y, words = rng.integers(0, 300, 800), rng.integers(0, 300, 800), rng.choice([5, 46, 50], 800)
    own, segs = S.merged(pair, x, y, words, 5)
    for p in np.unique(pair):
        some = pair == p
        assert (S.merged(pair[some], x[some], y[some], words[some], 5)[1] == segs[own == p]).all()
        covered = {(d, i) for a, b, n in segs[own == p].tolist() for d in [b - a] for i in range(a, a + n)}
        assert all({(b - a, i) for i in range(a, a + n)} <= covered for a, b, n in zip(x[some].tolist(), y[some].tolist(), words[some].tolist(), strict=True))


def test_seeds_and_windows_are_joined_by_sorting(spark, monkeypatch):
    """A partition's hash table could not spill: it ended a run where memory was short."""
    plans = []
    write = S.Scratch.write
    monkeypatch.setattr(S.Scratch, "write", lambda self, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()) or write(self, df, name))
    text = " ".join(f"word{i}" for i in range(60))
    found = S.repeated_passages(spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string"))
    assert [(r["a"], r["b"], r["n_equal"]) for r in found.collect()] == [(1, 2, 60)]
    assert plans and not any("ShuffledHashJoin" in p or "shuffle_hash" in p for p in plans)


def test_rare_seeds_and_windows_meet_their_first_without_a_join(spark, monkeypatch):
    """One sort by key serves; only what is frequent is joined. What is frequent is found in one pass over the texts."""
    plans = {}
    write = S.Scratch.write
    monkeypatch.setattr(S.Scratch, "write", lambda self, df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(self, df, name))
    text = " ".join(f"word{i}" for i in range(60))
    S.repeated_passages(spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string"))
    assert plans["met"].count("Window [") == 1 and plans["met"].count("Join") == 1 and plans["met"].count("MapInArrow") == 1
    assert plans["chains-0"].count("Window [") == 1 and plans["frequent"].count("MapInArrow") == 1


@pytest.mark.parametrize("n", range(12))
def test_seeds_of_few_words(n):
    """A run of texts may be one short text: all its shingles are one window."""
    hashes = np.random.default_rng(n).integers(1, 1 << 62, n).astype(np.uint64)
    own, pos, key = S.winnow(hashes, np.array([0, n]), 5, 8)
    assert len(pos) == (n >= 5) and not own.any()
    if n >= 5:
        g = S.grams(hashes, 5)
        assert pos[0] == np.argmin(g) and key[0] == S.mix(g[pos])[0]


def test_passages_whose_seeds_have_other_first_and_last_holders(spark):
    words = [f"p{i}" for i in range(300)]
    docs = [(100, " ".join(["x1", "x2", *words, "x3"])), (101, " ".join(["y1", *words, "y2", "y3"]))]
    for at in range(0, 300, 5):  # each fragment of 30 words in a lower and in a higher document
        docs += [(at // 5, " ".join([f"l{at}", *words[at : at + 30], f"m{at}"])), (200 + at // 5, " ".join([f"h{at}", *words[at : at + 30], f"g{at}"]))]
    rows = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(100, 101)}
    assert {i for r in rows for i in range(r["begin_b"], r["end_b"])} >= set(range(1, 301))


@pytest.mark.parametrize("seed", range(3))
def test_all_shared_windows_are_reported(spark, seed):
    rng = random.Random(seed)
    pool = [[f"s{seed}-{i}-{j}" for j in range(rng.randint(20, 90))] for i in range(12)] + [["la"] * 120, ["do", "re", "mi"] * 30]
    docs = []
    for i in range(40):
        own = []
        for _ in range(4):
            part, cut = rng.choice(pool), rng.randint(0, 9)
            own += [f"n{rng.random()}", *part[cut : len(part) - rng.randint(0, 9 - cut)]]
        docs.append((i, " ".join(own)))
    rows = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    covered = {(r["b"], i) for r in rows for i in range(r["begin_b"], r["end_b"])}
    seen = set()
    for i, text in docs:
        w = text.split(" ")
        own = {tuple(w[p : p + 50]): p for p in range(len(w) - 49)}
        for p in range(len(w) - 49):
            if tuple(w[p : p + 50]) in seen:
                assert all((i, q) in covered for q in range(p, p + 50)), (i, p)
        seen |= set(own)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination_is_decided_over_all_blocks(spark, block):
    items = [(i, " ".join(f"b{i}x{j}" for j in range(13))) for i in range(12)]
    fill = [f"f{i}" for i in range(400)]
    docs = [(n, " ".join(fill[: 400 - 13 * n] + [t for _, t in items[:n]])) for n in range(5)] + [(9, None), (10, "")]
    got = D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, *_, c in overlaps(docs, items) if not c) == [0, 1, 9, 10]


def test_later_copies_in_a_document_are_found(spark):
    words = [f"p{i}" for i in range(100)]
    again = [f"e{i}" if i % 20 == 19 else w for i, w in enumerate(words)]  # 80 equal words in a row nowhere: seeds find it
    docs = [(1, " ".join(["a1", *words, "a2"])), (2, " ".join(["b1", *words[30:45], "b2", *words, "b3", *again, "b4", *words]))]
    rows = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    covered = {i for r in rows for i in range(r["begin_b"], r["end_b"])}
    assert covered >= set(range(17, 117)) | set(range(118, 217)) | set(range(219, 319))


def test_repeated_ids_are_documents_of_their_own(spark, monkeypatch):
    words = [f"p{i}" for i in range(70)]
    docs = [(1, " ".join(["a", *words[:30]])), (1, " ".join(["b1", "b2", *words])), (2, " ".join([*words, "c"])), (2, "two"), (3, "three"), (2, " ".join([*words, "c"]))]
    docs += [(5, " ".join(f"q{i}" for i in range(90))), (5, " ".join(f"q{i}" for i in range(20, 90)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.repeated_passages(df.repartition(3)).collect()
    assert {(r["a"], r["begin_a"], r["end_a"], r["b"], r["begin_b"], r["end_b"]) for r in rows if r["a"] != 5} == {(1, 2, 72, 2, 0, 70)}
    assert {(r["b"], r["end_b"] - r["begin_b"]) for r in rows if r["a"] == 5} == {(5, 70)}
    kept = sorted((r["doc_id"], len(r["text"].split())) for r in S.cut_repeats(df).collect())
    assert [k for k in kept if k[0] != 5] == [(1, 31), (1, 72), (2, 1), (2, 1), (2, 1), (3, 1)]
    assert [n for i, n in kept if i == 5] in ([90], [20, 70])


def test_alignments_go_on_past_their_margin(spark):
    rng = random.Random(8)
    base = [f"p{i}" for i in range(900)]
    copy = [f"x{i}" if i % 9 == 8 and not 400 <= i < 425 else w for i, w in enumerate(base)]  # 13 equal words in a row only there
    docs = [(1, " ".join(["a", *base, *(f"a{i}" for i in range(50))])), (2, " ".join([*(f"b{i}" for i in range(40)), *copy, "b"])), (3, " ".join(rng.choices(["u", "v"], k=300)))]
    rows = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {i for r in rows for i in range(r["begin_b"], r["end_b"])} >= set(range(45, 935))


@pytest.mark.parametrize("seed", range(4))
def test_gaps_of_any_length_are_aligned_best(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(0, 30, n).astype(np.uint64) for n in (70, 90))
    best = S._common(x, y)[0]
    for cells in (1 << 14, 200, 5):
        monkeypatch.setattr(S, "CELLS", cells)
        cols = S.align_gap(x, y)
        assert sum(e for *_, e in cols) == best
        assert [i for i, *_ in cols if i >= 0] == list(range(70)) and [j for _, j, _ in cols if j >= 0] == list(range(90))
        assert all(e == (i >= 0 and j >= 0 and x[i] == y[j]) for i, j, e in cols)


def test_passages_of_random_documents_against_all_pairs(spark):
    rng = random.Random(21)
    pool = [[f"s{i}-{j}" for j in range(rng.randint(30, 140))] for i in range(40)]
    docs = []
    for i in range(300):
        own = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(pool)
            lo = rng.randint(0, len(part) // 2)
            own += [*(f"n{rng.random()}" for _ in range(rng.randint(1, 20))), *part[lo : rng.randint(lo, len(part))]]
        docs.append((rng.randint(0, 10**6), " ".join(own)))
    parts = [(i, " ".join(w)) for i, w in ((2 * 10**6, pool[0][:60]), (-5, pool[0][:60]))]
    docs = list(dict(docs + parts).items())
    rows = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    covered = {}
    for r in rows:
        for d, lo, hi in ((r["a"], r["begin_a"], r["end_a"]), (r["b"], r["begin_b"], r["end_b"])):
            covered.setdefault(d, set()).update(range(lo, hi))
    held = {}
    for i, text in docs:
        w = text.split(" ")
        for p in range(len(w) - 49):
            held.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    shared = [(i, p) for where in held.values() if len({i for i, _ in where}) > 1 for i, p in where if i > min(d for d, _ in where)]
    assert len(shared) > 1000 and all(set(range(p, p + 50)) <= covered[i] for i, p in shared)
