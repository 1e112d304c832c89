"""Invariants of the operators on small vectors."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetlake.functions import keys as K
from vetlake.functions.prefix import prefix_sums
from vetlake.operators import bootstrap as B
from vetlake.operators import corrupt as C
from vetlake.operators import fusion as X
from vetlake.operators import graph as G
from vetlake.operators import guards as V
from vetlake.operators import metrics as M
from vetlake.operators import patches as P
from vetlake.operators import selection as O
from vetlake.operators import splits as S
from vetlake.operators import vectors as VX


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, score double")


@pytest.mark.parametrize(("pairs", "want"), [([(0, 1), (1, 1)], 0.5), ([(1, 0), (1, 1)], None), ([(0, 0), (1, 1)], 1.0), ([(0, 2), (1, 1), (0, 0)], 0.5)])
def test_auroc_ties_and_single_class(spark, pairs, want):
    rows = scored(spark, pairs)
    assert M.rank_auroc(rows, []).first()["auroc"] == want
    assert M.areas(rows, []).first()["auroc"] == want


def test_auroc_forms_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    rows = scored(spark, zip(y, s)).repartition(7)
    assert M.rank_auroc(rows, []).first()["auroc"] == pytest.approx(want)
    assert M.areas(rows, []).first()["auroc"] == pytest.approx(want)


def test_scores_without_value_are_left_out(spark):
    rows = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, None), (None, 2.0)], "y int, score double")
    assert M.rank_auroc(rows, []).first().asDict() == {"positives": 1, "negatives": 1, "auroc": 1.0}


def test_slices_share_normals(spark):
    """Each slice's anomalies against all normals of their key: as by copying the normals, which the plan does not do."""
    rng = np.random.default_rng(21)
    rows = [(int(k), int(y), None if rng.random() < 0.05 else float(rng.integers(0, 25)), ["a", "b", "c", None][rng.integers(0, 4)] if y else "clean", int(rng.integers(0, 3)) if y else 0) for k, y in zip(rng.integers(0, 2, 400), rng.random(400) < 0.3)]
    rows += [(0, 1, None, "unscored", 9), (5, 1, 1.0, "a", 1)]
    df = spark.createDataFrame(rows, "k int, y int, score double, family string, severity int").repartition(5)
    got = {(r["k"], r["dimension"], r["slice"]): (r["positives"], r["negatives"], r["auroc"]) for r in M.slice_auroc(df, ["family", "severity"], ["k"]).collect()}
    want = {(k, d, str(v)) for k, y, _, f, s in rows if y for d, v in (("family", f), ("severity", s)) if v is not None}
    assert set(got) == want
    for k, d, v in want:
        pos = [r[2] for r in rows if r[0] == k and r[1] and str(r[3] if d == "family" else r[4]) == v and r[2] is not None]
        neg = [r[2] for r in rows if r[0] == k and not r[1] and r[2] is not None]
        auroc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) if pos and neg else None
        assert got[k, d, v] == (len(pos), len(neg), pytest.approx(auroc) if auroc is not None else None)
    counts = {(r["dimension"], r["slice"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in M.slice_confusion(df.where("score is not null"), ["family"], F.lit(12.0)).collect()}
    scored_rows = [r for r in rows if r[2] is not None]
    for v in ("a", "b", "c"):
        own = [r[2] > 12 for r in scored_rows if r[1] and r[3] == v]
        normal = [r[2] > 12 for r in scored_rows if not r[1]]
        assert counts["family", v] == (sum(own), sum(normal), len(normal) - sum(normal), len(own) - sum(own))


def test_confusion_identities(spark):
    pairs = [(1, 2)] * 130 + [(0, 2)] * 2 + [(0, 0)] * 14 + [(1, 0)] * 158
    got = M.confusion(scored(spark, pairs), [], F.lit(1.0)).first()
    assert got["precision"] == pytest.approx(0.984848, abs=1e-6)
    assert got["recall"] == pytest.approx(0.451389, abs=1e-6)
    assert got["f1"] == pytest.approx(0.619048, abs=1e-6)
    assert got["fpr"] == pytest.approx(0.125)


def test_threshold_is_strict(spark):
    assert M.confusion(scored(spark, [(1, 1.0)]), [], F.lit(1.0)).first()["tp"] == 0


def test_prevalence_identity(spark):
    rows = scored(spark, [(1, 2)] * 695 + [(1, 0)] * 361 + [(0, 2)] * 7 + [(0, 0)] * 121)
    got = M.at_prevalence(rows, [], 1.0, [0.05]).first()
    assert got["expected_precision"] == pytest.approx(0.3877807, abs=1e-6)
    assert got["false_alerts_per_1000"] == pytest.approx(51.953125)


def test_prefix_sums_across_ranges(spark):
    rng = np.random.default_rng(2)
    x = rng.permutation(500)
    df = spark.createDataFrame([(int(i % 3), float(v), int(v)) for i, v in enumerate(x)], "k int, o double, v long")
    got = {(r["k"], r["o"]): r["before_v"] for r in prefix_sums(df, ["k"], "o", ["v"]).collect()}
    got_in_ranges = {(r["k"], r["o"]): r["before_v"] for r in prefix_sums(df, ["k"], "o", ["v"], rows=20).collect()}
    falling = {(r["k"], r["o"]): r["before_v"] for r in prefix_sums(df, ["k"], "o", ["v"], descending=True, rows=20).collect()}
    for k in range(3):
        own = sorted(float(v) for i, v in enumerate(x) if i % 3 == k)
        for o, want in zip(own, itertools.accumulate([0, *own[:-1]])):
            assert got[k, o] == got_in_ranges[k, o] == want and falling[k, o] == sum(own) - want - o


def test_two_medians(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert O.quantiles(df, [], {"median": ("x", 0.5), "lower": ("x", 0.5, "lower")}).first() == (2.5, 2.0)


def plain_quantile(values, q, how="linear"):
    """By sorting; NaN last."""
    v = sorted(values, key=lambda x: (x != x, x))
    if not v:
        return None
    if how == "lower":
        return v[max(math.ceil(q * len(v)) - 1, 0)]
    k = q * (len(v) - 1)
    a, b = v[math.floor(k)], v[math.ceil(k)]
    return a if a == b or (a != a and b != b) else a + (b - a) * (k - math.floor(k))


@pytest.mark.parametrize(("ranges", "most", "few"), [(2048, 1 << 18, 20_000), (8, 4, 20_000), (64, 20, 5)])
def test_selection_is_sorting(spark, monkeypatch, ranges, most, few):
    """Many keys, null keys, columns and ranks at once; ties, heavy tails, extremes, groups of nulls; few parts and small sorts force many passes."""
    monkeypatch.setattr(O, "RANGES", ranges)
    monkeypatch.setattr(O, "SORTED", most)
    monkeypatch.setattr(O, "FINE", 4)
    monkeypatch.setattr(O, "FEW", few)
    rng = np.random.default_rng(8)
    inf = float("inf")
    groups = {"ties": rng.integers(0, 3, 90).astype(float), "tails": np.exp(rng.normal(0, 60, 80)), "one": np.array([5.0]), "same": np.full(70, -2.5), None: rng.normal(size=50), "ends": np.array([-inf, -inf, 1.0, 2.0, inf, inf, float("nan")]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 5e-324])}
    rows = [(g, 1, float(x), None if k % 5 == 0 else float(-x)) for g, v in groups.items() for k, x in enumerate(v)] + [("nulls", 1, None, None)] * 4
    df = spark.createDataFrame(rows, "g string, h int, a double, b double").repartition(3)
    wanted = {"m": ("a", 0.5), "lower": ("a", 0.5, "lower"), "q99": ("a", 0.99), "q0": ("b", 0.0), "q1": ("b", 1.0, "lower"), "third": ("b", 1 / 3)}
    got = {r["g"]: r for r in O.quantiles(df, ["g", "h"], wanted).collect()}
    assert set(got) == {*groups, "nulls"}
    for g, r in got.items():
        for name, (c, q, *how) in wanted.items():
            want = plain_quantile([x[2 if c == "a" else 3] for x in rows if x[0] == g and x[2 if c == "a" else 3] is not None], q, *how)
            assert r[name] == want or (want != want and r[name] != r[name]) or r[name] == pytest.approx(want, rel=1e-12), (g, name)
    assert O.quantiles(df.where("false"), [], {"m": ("a", 0.5)}).collect() == [(None,)]
    assert O.quantiles(df.where("false"), ["g"], {"m": ("a", 0.5)}).collect() == []


def test_zero_deviation_falls_back(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 0, 1, 2)], "a double")
    got = X.fit(df, ["a"], "spread").first()
    assert got["median_a"] == 0
    assert got["scale_a"] == pytest.approx(1.5 / 2.563)


@pytest.mark.parametrize(("policy", "want"), [("plus", 1e-6), ("most", 1e-6), ("clamp", 0.01)])
def test_scale_floors(spark, policy, want):
    df = spark.createDataFrame([(1.0,)] * 5, "a double")
    assert X.fit(df, ["a"], policy).first()["scale_a"] == pytest.approx(want)


def test_non_finite_scores_are_not_flagged(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "score double")
    limit = spark.createDataFrame([(1.0,)], "threshold double")
    assert [r["flagged"] for r in X.flag(rows, limit, []).collect()] == [False, False, True, False]


def test_keys(spark):
    names = [("ESP_012373_0930_RED-0050-r90.jpg",), ("ESP_012373_0930_RED-0050.jpg",), ("x_rot180-hflip.tif",), (None,), ("",)]
    df = spark.createDataFrame(names, "p string")
    base = K.base_id(K.stem(F.col("p")))
    got = [tuple(r) for r in df.select(base, K.source_id(base), K.augmentations(K.stem(F.col("p")))).collect()]
    assert got[0] == ("esp_012373_0930_red-0050", "esp_012373_0930", ["r90"])
    assert got[1] == ("esp_012373_0930_red-0050", "esp_012373_0930", [])
    assert got[2] == ("x", None, ["rot180", "hflip"])


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (12, 64))
    all_bits = np.concatenate([base, base ^ (rng.random((12, 64)) < 0.04), base[:3]])
    rows = [(i, "".join(map(str, b))) for i, b in enumerate(all_bits.tolist())]
    want = {(i, j): sum(x != y for x, y in zip(a, b)) for (i, a), (j, b) in itertools.combinations(rows, 2)}
    df = spark.createDataFrame([*rows, (99, None)], "id long, bits string")
    for t in (0, 4, 7, 20, 64):
        got = {(r["a"], r["b"]): r["distance"] for r in G.near_pairs(df, "id", "bits", t).collect()}
        near = {p: d for p, d in want.items() if d <= t}
        # copies of a string are handed to its first row; pairs between different strings name first rows
        first = {}
        rep = {i: first.setdefault(b, i) for i, b in rows}
        expected = {tuple(sorted((rep[i], rep[j]))): d for (i, j), d in near.items() if rep[i] != rep[j]} | {(rep[i], i): 0 for i in rep if rep[i] != i}
        assert got == expected


def _copies(seed, n=60):
    """(id, bits, label) rows with copies of strings, a repeated id, and nulls."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (n, 64))
    base = np.concatenate([base, base[:20] ^ (rng.random((20, 64)) < 0.1), base[:9], base[:5], base[:1]])
    rows = [(int(i), "".join(map(str, b)), [None, 0, 1, 2][i % 4]) for i, b in zip(rng.permutation(len(base)), base.tolist(), strict=True)]
    return [*rows, (rows[0][0], rows[3][1], 1), (900, None, 1), (None, rows[0][1], 1)]


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_every_near_pair_has_the_pairs_of_copies(spark, block):
    rows = _copies(5)
    df = spark.createDataFrame(rows, "id long, bits string, label int").repartition(3)
    for t in (0, 20, 64):
        got = sorted(map(tuple, G.every_near_pair(df, "id", "bits", t, block).collect()))
        far = lambda x, y: sum(p != q for p, q in zip(x, y))
        whole = [(i, b) for i, b, _ in rows if i is not None and b is not None]
        assert got == sorted((i, j, far(x, y)) for i, x in whole for j, y in whole if i < j and far(x, y) <= t)


@pytest.mark.parametrize("query", ["near_duplicate_pairs", "near_pair_report"])
def test_near_pairs_are_never_shuffled(spark, query):
    """Only strings are dealt, to cells; what a task finds is not joined, nor dealt again but as one row of counts for each cell."""
    from vetlake.plans import inventory

    plan = getattr(inventory, query)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    after, _, before = plan.partition("MapInArrow")
    assert "Join" not in plan and "Repartition" not in after and before.count("Repartition") == 1


def test_cells_copy_a_row_a_bounded_number_of_times(spark):
    """However small blocks are beside the rows: else the shuffle would grow with the square of the rows."""
    df = spark.range(300).withColumn("x", F.col("id"))
    for block, ways in ((1000, 1), (100, 3), (7, G.WAYS), (1, G.WAYS)):
        cells = G._cells(df, "id", block)
        assert cells.count() == 300 * ways and cells.select("cell").distinct().count() == ways * (ways + 1) // 2


def test_near_pair_counts_equal_brute_force(spark):
    rows = _copies(6)
    whole = [r for r in rows if r[0] is not None and r[1] is not None]
    units = [(i, b, y) for i, b, _ in whole for k, _, y in rows if k == i]
    near = [(p[2], q[2]) for p in units for q in units if p[0] < q[0] and sum(x != y for x, y in zip(p[1], q[1])) <= 20]
    known = [x == y for x, y in near if x is not None and y is not None]
    df = spark.createDataFrame(rows, "id long, bits string, label int").repartition(3)
    for block in (11, 1000):
        assert tuple(G.near_pair_counts(df, "id", "bits", "label", 20, block).first()) == (len(near), sum(known), len(known) - sum(known))
    assert tuple(G.near_pair_counts(df.limit(0), "id", "bits", "label", 20).first()) == (0, 0, 0)


def test_near_pair_counts_join_numbers_not_strings(spark, monkeypatch):
    """What meets its labels is 8 bytes of a string: the characters are read below the join and end there."""
    seen, real = [], G.kept
    monkeypatch.setattr(G, "kept", lambda df, name: seen.append(df) or real(df, name))
    df = spark.createDataFrame(_copies(7), "id long, bits string, label int")
    G.near_pair_counts(df, "id", "bits", "label", 20)
    above, join, below = seen[0]._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert join and "bits" in below and "bits" not in above


def test_near_forest_joins_what_near_pairs_join_with_few_links(spark):
    rows = _copies(8)
    whole = [(i, b) for i, b, _ in rows if i is not None and b is not None]
    df = spark.createDataFrame(rows, "id long, bits string, label int").repartition(3)

    def roots(links):
        root = {i: i for i, _ in whole}
        for _ in range(len(whole)):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    for t, block in ((0, 1000), (12, 9), (20, 40)):
        links = [tuple(r) for r in G.near_forest(df, "id", "bits", t, block).collect()]
        assert roots(links) == roots([(i, j) for i, x in whole for j, y in whole if i < j and sum(p != q for p, q in zip(x, y)) <= t])
        assert all(i < j for i, j in links) and len(links) <= len(whole) * -(-len(whole) // block)


def test_probe_plans_are_complete_and_cheap():
    """Whatever bits differ, a block is within its radius; few candidates at narrow thresholds, at wide ones fewer than pairs."""
    rng = np.random.default_rng(33)
    for t, n in ((0, 100), (4, 10**6), (7, 10**9), (13, 10**4), (20, 50_000), (33, 10**7), (64, 50)):
        plan = G.probe_plan(t, n)
        for _ in range(300):
            apart = sum(1 << int(b) for b in rng.permutation(64)[:t])
            assert any((apart >> lo & (1 << width) - 1).bit_count() <= r for lo, width, r in plan)
        assert sum(width for _, width, _ in plan) <= 64
    share = lambda t, n: sum(G.ball(w, r) / 2**w for _, w, r in G.probe_plan(t, n))
    assert share(4, 50_000) < 1e-3 and share(8, 50_000) < 0.01 and share(12, 10**6) < 0.05 and share(20, 50_000) < 0.5


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)]
    parent = list(range(130))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = spark.range(130).withColumnRenamed("id", "node_id")
    got = {r["node_id"]: r["root"] for r in G.components(nodes, spark.createDataFrame(links, "a long, b long"), "node_id").collect()}
    assert got == {i: find(i) for i in range(130)}


def test_halves_and_splits_cover_groups_once(spark):
    df = spark.createDataFrame([(f"g{i % 11}",) for i in range(50)] + [(None,)], "g string")
    halves = S.hash_halves(df, "g").collect()
    assert sorted(r["half"] for r in halves).count("A") == 5 and len(halves) == 11
    split = S.grouped_split(df, "g", {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert len(split) == 11 and {r["assigned_split"] for r in split} == {"train", "val", "test"}


@pytest.mark.parametrize("prefix", [0, 1, 3])
def test_covered_split_is_the_first_that_covers(spark, monkeypatch, prefix):
    """As by sorting every attempt's groups: places come from counts of prefixes, also where all groups share one."""
    monkeypatch.setattr(S, "PREFIX", prefix)
    rng = np.random.default_rng(41)
    rows = [(f"g{k}", f"c{c}") for k in range(23) for c in set(rng.integers(0, 4, 2).tolist())] + [(None, "c0"), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, c string").repartition(3)
    shares, names = {"train": 0.7, "val": 0.15, "test": 0.15}, ["train", "val", "test"]
    classes = {c for g, c in rows if g and c}
    groups = sorted({g for g, c in rows if g and c})

    def split(attempt):
        order = sorted(groups, key=lambda g: hashlib.sha256(f"{attempt}:{g}".encode()).hexdigest())
        cut = [math.floor(0.7 * len(order) + 0.5), math.floor(0.85 * len(order) + 0.5)]
        return {g: names[sum(k >= c for c in cut)] for k, g in enumerate(order)}

    first = next(a for a in range(200) if {(split(a)[g], c) for g, c in rows if g and c} == {(n, c) for n in names for c in classes})
    got = S.covered_split(df, "g", "c", shares, 200).collect()
    assert {r["g"]: r["assigned_split"] for r in got} == split(first) and {r["attempt"] for r in got} == {first}
    assert S.covered_split(df, "g", "c", shares, first).count() == 0
    assert S.covered_split(df.where("g = 'g0'"), "g", "c", shares, 4).count() == 0


def test_validation_groups():
    classes = {"a": {1}, "b": {1, 2}, "c": {2}, "d": {3}}
    assert S.validation_groups(classes, 2) == ["a", "c"]
    assert S.validation_groups({"a": {1}}) == []
    assert S.validation_groups({}) == []


def test_guards(spark):
    rows = spark.createDataFrame([("train", "a"), ("test", "a"), ("train", "b"), ("test", None)], "role string, k string")
    found = {(r["value"], r["roles"]) for r in V.shared_keys(rows, "role", ["k"]).collect()}
    assert found == {("a", 2), (None, 1)}
    with pytest.raises(V.ViolationError):
        V.none(V.shared_keys(rows, "role", ["k"]), "shared")
    V.none(V.shared_keys(rows.where("k = 'b'"), "role", ["k"]), "shared")


def test_knn_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(77, None)], "id long, v array<double>")
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    want = {i: np.argsort(d[i])[:3].tolist() for i in range(40)}
    for block in (100, 7):
        got = {}
        for r in VX.cosine_knn(df, df, "id", "v", 3, block=block).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["other"])
        assert got == want


def test_knn_of_seven_by_five_blocks(spark, monkeypatch):
    """Blocks on both sides, chunks within them, equal vectors as ties, an id on one side only, k beyond a block."""
    monkeypatch.setattr(VX, "QUERIES", 4)
    monkeypatch.setattr(VX, "BANK", 3)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(70, 5))
    x[10:14] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = lambda ids: spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "id long, v array<float>").repartition(3)
    queries, bank = frame(range(70)), frame(range(20, 70)).unionAll(frame([3, 12, 11, 10]))
    x = x.astype(np.float32).astype(float)
    ids = np.array([*range(20, 70), 3, 12, 11, 10])
    for k in (3, 9):
        got = {}
        for r in VX.cosine_knn(queries, bank, "id", "v", k, block=10).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["other"], round(r["distance"], 10)))
        for i in range(70):
            near = sorted((round(1 - float(np.clip(x[i] @ x[j], -1, 1)), 12), int(j)) for j in ids if j != i)[:k]
            assert got[i] == [(j, round(d, 10)) for d, j in near]
    plan = VX.cosine_knn(queries, bank, "id", "v", 3, block=10)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_moments_keep_digits(spark, monkeypatch):
    monkeypatch.setattr(VX, "FAN", 2)
    rng = np.random.default_rng(16)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + np.array([1e8, -1e8, 0])
    df = spark.createDataFrame([(v,) for v in x.tolist()] + [(None,)], "v array<double>").repartition(9)
    want = np.cov((x - np.array([1e8, -1e8, 0])).T)
    rows = VX.moments(df, "v").collect()
    assert [(r["i"], r["j"]) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    for r in rows:
        assert r["covariance"] == pytest.approx(want[r["i"], r["j"]], rel=1e-6) and r["mean_i"] == pytest.approx(x[:, r["i"]].mean(), rel=1e-14)
    assert VX.moments(df.where("v is null"), "v").count() == 0
    assert [r["covariance"] for r in VX.moments(spark.createDataFrame([([1.0],)], "v array<double>"), "v").collect()] == [None]


def test_latent_is_mahalanobis(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    c = x - x.mean(0)
    for shrink in (0.1, 1.0, 1e-9):
        got = np.array([r["latent"] for r in VX.score_latent(df, "id", "v", VX.fit_latent(df, "v", 4, shrink)).orderBy("id").collect()])
        own = np.cov(x.T)
        inverse = np.linalg.inv((1 - shrink) * own + shrink * np.trace(own) / 4 * np.eye(4))
        assert np.allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", c, inverse, c)))
    for shrink in (0.0, 1.1):
        with pytest.raises(ValueError):
            VX.fit_latent(df, "v", 4, shrink)


def test_outlier_of_constant_vectors_has_a_distance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "id long, v array<double>")
    state = VX.fit_latent(same, "v")
    rows = same.unionAll(spark.createDataFrame([(9, [1.0, 2.0, 4.0])], "id long, v array<double>"))
    got = {r["id"]: r["latent"] for r in VX.score_latent(rows, "id", "v", state).collect()}
    assert got[0] == 0 and got[9] == pytest.approx(1 / math.sqrt(0.1 * 1e-8))


@pytest.mark.parametrize(("n", "ceil", "floor"), [(10, 1, 1), (30, 2, 1)])
def test_top_mean_rounding(spark, n, ceil, floor):
    df = spark.createDataFrame([([float(i) for i in range(n)],)], "v array<double>")
    got = df.select(VX.top_mean(F.col("v"), 0.05, "ceil"), VX.top_mean(F.col("v"), 0.05, "floor")).first()
    assert got == (np.mean(range(n - ceil, n)), np.mean(range(n - floor, n)))


def test_box_and_laplacian(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8, 8))
    px = spark.createDataFrame([(0, i, j, float(x[i, j])) for i in range(8) for j in range(8)], "case_id int, y int, x int, v double")
    got = P.laplacian(P.box_mean(px, 3)).collect()
    p, q = np.pad(x, 1), np.pad(x, 1, "reflect")
    for r in got:
        i, j = r["y"], r["x"]
        assert r["box"] == pytest.approx(p[i : i + 3, j : j + 3].sum() / 9)
        assert r["laplacian"] == pytest.approx(q[i, j + 1] + q[i + 2, j + 1] + q[i + 1, j] + q[i + 1, j + 2] - 4 * x[i, j])


def test_covering_masks_cover_once(spark):
    grid = spark.range(128 * 128).select(F.floor(F.col("id") / 128).alias("y"), (F.col("id") % 128).alias("x"))
    counts = grid.groupBy(P.covering_mask(F.col("y"), F.col("x"), 128).alias("m")).count().collect()
    assert {r["m"]: r["count"] for r in counts} == dict.fromkeys(range(4), 128 * 128 // 4)


def test_schedule_falls():
    s = P.noise_schedule(20)
    assert len(s) == 20 and all(a > b > 0 for a, b in zip(s, s[1:]))


@pytest.mark.parametrize("kind", C.KINDS)
def test_corruptions_are_deterministic(kind):
    image = np.random.default_rng(8).random((32, 32))
    a, b = (C.corrupt(image, kind, 0.5, 42) for _ in range(2))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert a[0].min() >= 0 and a[0].max() <= 1 and a[1].any()


@pytest.mark.parametrize("family", C.STRESS)
def test_stress_is_deterministic(family):
    image = np.random.default_rng(9).random((32, 32))
    a, b = (C.stress(image, family, 0.3, 42) for _ in range(2))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[1].any()


def test_stress_regions():
    image = np.random.default_rng(9).random((64, 64))
    side = lambda f, s: int(C.stress(image, f, s, 1)[1].any(0).sum())
    assert [side("missing_patch", s) for s in C.SEVERITIES] == [8, 11, 16]  # 64 (0.08 + 0.35 s)
    full = [int(64 * (0.25 + 0.3 * s)) for s in C.SEVERITIES]
    assert full == [18, 21, 25] and all(side("local_blur", s) == n for s, n in zip(C.SEVERITIES, full) if C.stress(image, "missing_patch", s, 1)[1].any(0).argmax() + n <= 64)
    out, mask = C.stress(image, "patch_duplication", 0.5, 1)
    assert mask.any(1).nonzero()[0].tolist() == list(range(46, 62))
    assert np.allclose(out[46:62, 46:62], np.rint(255 * image[2:18, 2:18]) / 255)
    assert len({tuple(np.argwhere(C.stress(image, "missing_patch", s, 7)[1])[0]) for s in C.SEVERITIES}) == 1  # one corner for all
    rows, columns = (C.stress(np.full((16, 16), 0.5), "stripes", 0.3, n)[0] for n in (1, 2))
    assert np.ptp(rows, axis=1).max() == 0 and np.ptp(columns, axis=0).max() == 0  # odd seeds vary from row to row
    black = np.zeros((16, 16))
    assert not C.stress(black, "missing_patch", 0.3, 1)[1].any()
    with pytest.raises(ValueError):
        C.stress(image, "stripes", 0.4, 1)


def test_corruption_regions():
    image = np.arange(64.0).reshape(8, 8) / 64
    box = (2, 2, 4)
    for odd in (0, 1):
        out = C.corrupt(image, "block_permutation", 0.3, odd, box)[0]
        assert (out[2:6, 2:6] == np.roll(image[2:6, 2:6], 2, odd)).all()  # one axis, by the seed's parity
    other = np.linspace(0, 1, 16).reshape(4, 4)
    assert (C.corrupt(image, "foreign", 0.3, 1, box, other)[0][2:6, 2:6] == other).all()
    assert set(C.KINDS.values()) == {"stripes", "dead lines/pixels", "clipping", "blur/noise", "missing crop", "block corruption", "patch duplication", "foreign/synthetic contamination"}
    with pytest.raises(ValueError):
        C.corrupt(image, "stripes", 0, 1)


def test_cases_that_change_nothing_say_so(spark):
    df = spark.createDataFrame([(1, [0.0] * 64)], "id long, v array<double>")
    got = C.cases(df, "id", "v", ["missing_patch", "foreign_content"], [0.3], C.stress).collect()
    assert {r["family"]: r["status"] for r in got} == {"missing_patch": "unchanged", "foreign_content": "ok"}
    seeds = {r["seed"] for s in (0.15, 0.3) for r in C.cases(df, "id", "v", ["foreign"], [s]).collect()}
    assert len(seeds) == 2  # severity is in the seed of corrupt


def test_names_lose_every_augmentation(spark):
    stems = {"A-r90": "a", "a_rotate_90": "a", "a.rot-180": "a", "a_brightness_0.8": "a", "a_brightness": "a", "a_brightness-1.2_R270": "a", "a_brightness_0.8.r90": "a", "a_fh-flip_v": "a", "a_brightnessmap": "a_brightnessmap", "a_rot45": "a_rot45", "a_r90_x": "a_r90_x", "r90": "r90"}
    df = spark.createDataFrame([(s,) for s in stems], "s string")
    got = {r["s"]: (r["b"], r["t"]) for r in df.select("s", K.base_id(F.col("s")).alias("b"), K.augmentations(F.col("s")).alias("t")).collect()}
    assert {s: b for s, (b, _) in got.items()} == stems
    assert got["a_brightness_0.8.r90"][1] == ["brightness_0.8", "r90"] and got["a_brightness-1.2_R270"][1] == ["brightness-1.2", "r270"] and got["a_rot45"][1] == []


def test_vectors_without_rows(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert VX.cosine_knn(some, none, "id", "v", 3).count() == 0 and VX.cosine_knn(none, some, "id", "v", 3).count() == 0
    for rows in (none, some):
        with pytest.raises(ValueError):
            VX.fit_latent(rows, "v")


def test_cases_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, rng.random(64).tolist()) for i in range(6)], "id long, v array<double>")
    one, many = (sorted(map(str, C.cases(df.repartition(n), "id", "v", ["dead_pixels", "foreign"], [0.3]).collect())) for n in (1, 5))
    assert one == many and len(one) == 12


def test_binomial_inversion():
    """The least k whose distribution function reaches u, as by adding up; moments for draws too many to add up."""
    rng = np.random.default_rng(30)
    for m, p in ((1, 0.5), (7, 0.3), (40, 0.97), (300, 0.01)):
        pmf = [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]
        for u in rng.random(50):
            assert B.binomial_at(m, p, u) == next(k for k in range(m + 1) if sum(pmf[: k + 1]) >= u)
    assert B.binomial_at(10, 0, 0.5) == 0 and B.binomial_at(10, 1, 0.5) == 10 and B.binomial_at(0, 0.3, 0.5) == 0
    got = (np.array([B.binomial_at(10**9, 0.25, u) for u in (np.arange(40) + 0.5) / 40]) - 2.5e8) / math.sqrt(10**9 * 0.25 * 0.75)
    assert abs(got.mean()) < 1e-3 and got.std() == pytest.approx(1, abs=0.05)


def test_draws_are_multinomial(spark, monkeypatch):
    """Every replicate draws as many units as there are, whatever the levels of the tree and the partitions; counts vary as a multinomial's."""
    df = spark.createDataFrame([(f"u{k}",) for k in range(600) for _ in range(k % 3 + 1)] + [(None,)], "unit string").repartition(7)
    plain = {r["unit"]: list(r["times"]) for r in B.unit_draws(df, "unit", 40).collect()}
    assert set(plain) == {f"u{k}" for k in range(600)}
    times = np.array(list(plain.values()))
    assert (times.sum(0) == 600).all() and times.mean() == 1 and times.max() > 6 - 1
    assert times.var() == pytest.approx(1 - 1 / 600, abs=0.05)
    assert [(times == k).mean() for k in range(4)] == pytest.approx([math.comb(600, k) / 600**k * (1 - 1 / 600) ** (600 - k) for k in range(4)], abs=0.01)
    monkeypatch.setattr(B, "UNITS", 5)
    monkeypatch.setattr(B, "LEVELS", 3)
    assert {r["unit"]: list(r["times"]) for r in B.unit_draws(df.repartition(2), "unit", 40).collect()} == plain


def test_units_whose_hashes_agree_are_drawn():
    got = B.shared_draws(np.array([5, 5, 5, 6]), np.ones(4, np.int64), np.full(300, 4), 0, 4, "s")
    assert (got.sum(0) == 4).all() and got.mean(1) == pytest.approx(np.ones(4), abs=0.2)


@pytest.mark.parametrize("cells", [1 << 22, 60])
def test_bootstrap_is_resampling(spark, monkeypatch, cells):
    """The auroc of rows written out as often as their unit is drawn; with many ranges and a score that crowds one."""
    monkeypatch.setattr(B, "CELLS", cells)
    rng = np.random.default_rng(31)
    rows = [(int(u), int(y), 3.0 if rng.random() < 0.4 else float(rng.integers(0, 30))) for u, y in zip(rng.integers(0, 50, 400), rng.random(400) < 0.4)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0), (2, 1, None)], "unit long, y int, score double").repartition(4)
    got = {r["replicate"]: r["auroc"] for r in B.bootstrap_auroc(df, "unit", 6).collect()}
    times = {r["unit"]: r["times"] for r in B.unit_draws(df.where("unit is not null and y is not null and score is not null"), "unit", 6).collect()}
    for r in range(6):
        pos = np.repeat([s for u, y, s in rows if y], [times[u][r] for u, y, s in rows if y])
        neg = np.repeat([s for u, y, s in rows if not y], [times[u][r] for u, y, s in rows if not y])
        assert got[r] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    one = B.bootstrap_auroc(df.where("y = 1"), "unit", 3).collect()
    assert len(one) == 3 and all(r["auroc"] is None for r in one)
    assert B.bootstrap_auroc(df.where("false"), "unit", 3).count() == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "y int, score double")
    assert M.rank_auroc(none, ["y"]).count() == 0
    assert M.rank_auroc(none, []).first()["auroc"] is None
    links = spark.createDataFrame([], "a long, b long")
    assert G.components(spark.createDataFrame([], "id long"), links, "id").count() == 0
