"""Robust calibration, fusion, thresholds, ablations and explanations over lineitem's four branch scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.robust import scale
from ..operators import fusion as X
from ..operators import metrics as M
from ..operators.selection import quantiles
from ..operators.splits import hash_halves
from ..sources.fixtures import BRANCHES_SQL, branch_scores
from . import query

B = X.BRANCHES
#: The three channels and their eight subsets, as cached candidates combine them.
SUBSETS = [("diffusion",), ("semantic",), ("spectral",), ("diffusion", "semantic"), ("diffusion", "spectral"), ("semantic", "spectral"), ("diffusion", "semantic", "spectral"), B]


def r(c: str):
    return F.round(c, 6).alias(c)


def _long(column):
    """One row for each branch from a one-row frame of <what>_<branch> columns."""
    return F.explode(F.array(*(F.struct(F.lit(b).alias("branch"), *(F.col(f"{what}_{b}").cast("double").alias(what) for what in column)) for b in B)))


_UN = f"{BRANCHES_SQL}, u AS (" + " UNION ALL ".join(f"SELECT '{b}' AS branch, {b} AS v FROM b WHERE y = 0" for b in B) + ")"
_MED = f"{_UN}, a AS (SELECT branch, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS spread FROM u GROUP BY branch), d AS (SELECT branch, quantile_cont(abs(v - median), 0.5) AS mad FROM u JOIN a USING (branch) GROUP BY branch)"


@query(f"WITH {_MED} SELECT branch, round(median, 6) AS median, round(1.4826 * mad + 1e-6, 6) AS scale FROM a JOIN d USING (branch)")
def robust_fit_interp(spark, sf_dir):
    state = X.fit(branch_scores(spark, sf_dir).where("y = 0"), policy="plus")
    return state.select(_long(("median", "scale")).alias("s")).select("s.branch", F.round("s.median", 6).alias("median"), F.round("s.scale", 6).alias("scale"))


@query(f"""WITH {_UN}, a AS (SELECT branch, quantile_disc(v, 0.5) AS median FROM u GROUP BY branch),
d AS (SELECT branch, quantile_disc(abs(v - median), 0.5) AS mad FROM u JOIN a USING (branch) GROUP BY branch)
SELECT branch, round(median, 6) AS median, round(greatest(1.4826 * mad, 0.01), 6) AS scale FROM a JOIN d USING (branch)""")
def robust_fit_disc(spark, sf_dir):
    rows = branch_scores(spark, sf_dir).where("y = 0").select(F.explode(F.array(*(F.struct(F.lit(b).alias("branch"), F.col(b).alias("v")) for b in B))).alias("s")).select("s.*")
    first = quantiles(rows, ["branch"], {"median": ("v", 0.5, "lower")})
    gone = rows.join(first, "branch").withColumn("d", F.abs(F.col("v") - F.col("median")))
    return first.join(quantiles(gone, ["branch"], {"mad": ("d", 0.5, "lower")}), "branch").select("branch", r("median"), F.round(scale(F.col("mad"), "clamp"), 6).alias("scale"))


@query(f"WITH {_MED} SELECT branch, round(median, 6) AS median, round(greatest(CASE WHEN mad <= 1e-6 THEN spread / 2.563 ELSE 1.4826 * mad END, 1e-6), 6) AS scale FROM a JOIN d USING (branch)")
def robust_fit_spread(spark, sf_dir):
    state = X.fit(branch_scores(spark, sf_dir).where("y = 0"), policy="spread")
    return state.select(_long(("median", "scale")).alias("s")).select("s.branch", F.round("s.median", 6).alias("median"), F.round("s.scale", 6).alias("scale"))


def _state_sql(policy: str) -> str:
    s = {"plus": "1.4826 * mad + 1e-6", "most": "greatest(1.4826 * mad, 1e-6)"}[policy]
    one = ", ".join(f"max(CASE WHEN branch = '{b}' THEN median END) AS m_{b}, max(CASE WHEN branch = '{b}' THEN {s} END) AS s_{b}" for b in B)
    return f"{_MED}, st AS (SELECT {one} FROM a JOIN d USING (branch))"


_CLIP = ", ".join(f"least(greatest(({b} - m_{b}) / s_{b}, 0), 100) AS z_{b}" for b in B)
_RAW = ", ".join(f"({b} - m_{b}) / s_{b} AS z_{b}" for b in B)
_ZC = f"{_state_sql('plus')}, z AS (SELECT b.*, {_CLIP} FROM b, st)"
_ZR = f"{_state_sql('most')}, z AS (SELECT b.*, {_RAW} FROM b, st)"


def _clipped(spark, sf_dir):
    rows = branch_scores(spark, sf_dir)
    return X.with_z(rows, X.fit(rows.where("y = 0"), policy="plus"), clip=True)


def _raw(spark, sf_dir):
    rows = branch_scores(spark, sf_dir)
    return X.with_z(rows, X.fit(rows.where("y = 0"), policy="most"))


@query(f"WITH {_ZC} SELECT y, " + ", ".join(f"round(avg(z_{b}), 6) AS z_{b}" for b in B) + " FROM z GROUP BY y")
def robust_z_clipped(spark, sf_dir):
    return _clipped(spark, sf_dir).groupBy("y").agg(*(F.round(F.avg(f"z_{b}"), 6).alias(f"z_{b}") for b in B))


def _weights_sql() -> str:
    return " UNION ALL ".join(f"SELECT base_id, line, y, family, '{name}' AS variant, " + " + ".join(f"{w!r} * z_{b}" for b, w in zip(B, ws, strict=True) if w) + " AS score FROM z" for name, ws in X.WEIGHTS.items())


_FUSED = f"{_ZC}, f AS ({_weights_sql()})"


@query(f"WITH {_FUSED} SELECT variant, count(*) AS n, round(avg(score), 6) AS mean, round(max(score), 6) AS top FROM f GROUP BY variant")
def fuse_fixed_weights(spark, sf_dir):
    rows = X.by_variant(_clipped(spark, sf_dir), X.weight_variants())
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("top"))


def _subset_sql(subsets) -> str:
    out = []
    for s in subsets:
        z = [f"z_{b}" for b in s]
        out.append(f"SELECT base_id, line, split_group_id, y, '{'+'.join(s)}_mean' AS variant, ({' + '.join(z)}) / {len(z)} AS score FROM z")
        if len(z) > 1:
            out.append(f"SELECT base_id, line, split_group_id, y, '{'+'.join(s)}_max' AS variant, greatest({', '.join(z)}) AS score FROM z")
    return " UNION ALL ".join(out)


@query(f"WITH {_ZR}, f AS ({_subset_sql(SUBSETS)}) SELECT variant, round(quantile_cont(score, 0.95), 6) AS threshold, round(avg(score), 6) AS mean FROM f WHERE y = 0 GROUP BY variant")
def fuse_mean_max_variants(spark, sf_dir):
    rows = X.by_variant(_raw(spark, sf_dir).where("y = 0"), X.subset_variants(B, SUBSETS))
    means = rows.groupBy("variant").agg(F.round(F.avg("score"), 6).alias("mean"))
    return X.thresholds(rows, ["variant"], 0.95).select("variant", r("threshold")).join(means, "variant")


@query(f"WITH {_FUSED} SELECT variant, round(quantile_cont(score, 0.99), 6) AS threshold FROM f WHERE y = 0 GROUP BY variant")
def threshold_q99(spark, sf_dir):
    rows = X.by_variant(_clipped(spark, sf_dir).where("y = 0"), X.weight_variants())
    return X.thresholds(rows, ["variant"], 0.99).select("variant", r("threshold"))


_HALVES = "h AS (SELECT g AS split_group_id, CASE WHEN row_number() OVER (ORDER BY sha256('42' || CAST(g AS VARCHAR))) <= (SELECT count(DISTINCT l_suppkey) FROM lineitem) // 2 THEN 'A' ELSE 'B' END AS half FROM (SELECT DISTINCT l_suppkey AS g FROM lineitem))"


@query(f"""WITH {BRANCHES_SQL}, {_HALVES}, n AS (SELECT b.*, half FROM b JOIN h USING (split_group_id) WHERE y = 0),
a AS (SELECT quantile_cont(semantic, 0.5) AS m FROM n WHERE half = 'A'), d AS (SELECT quantile_cont(abs(semantic - m), 0.5) AS mad FROM n, a WHERE half = 'A')
SELECT count(*) AS n, round(quantile_cont((semantic - m) / greatest(1.4826 * mad, 1e-6), 0.95), 6) AS threshold FROM n, a, d WHERE half = 'B'""")
def threshold_q95_b(spark, sf_dir):
    rows = branch_scores(spark, sf_dir).where("y = 0")
    rows = rows.join(hash_halves(rows, "split_group_id"), "split_group_id")
    state = X.fit(rows.where("half = 'A'"), ["semantic"], "most")
    second = X.with_z(rows.where("half = 'B'"), state, ["semantic"])
    return second.agg(F.count(F.lit(1)).alias("n")).crossJoin(quantiles(second, [], {"threshold": ("z_semantic", 0.95)}).select(r("threshold")))  # one row each


def _ablations(spark, sf_dir):
    rows = X.by_variant(_clipped(spark, sf_dir), X.weight_variants())
    limit = X.thresholds(rows.where("y = 0"), ["variant"], 0.99)
    rates = M.confusion(rows.join(F.broadcast(limit), "variant"), ["variant"], F.col("threshold"))
    return rates.join(M.rank_auroc(rows, ["variant"]).select("variant", "auroc"), "variant").join(limit, "variant")


_ABL = f"""{_FUSED}, t AS (SELECT variant, quantile_cont(score, 0.99) AS threshold FROM f WHERE y = 0 GROUP BY variant),
q AS (SELECT variant, count(*) FILTER (score > threshold AND y = 1) AS tp, count(*) FILTER (score > threshold AND y = 0) AS fp, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM f JOIN t USING (variant) GROUP BY variant),
c AS (SELECT variant, score, sum(y) AS pos, sum(1 - y) AS neg FROM f GROUP BY variant, score),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY variant ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
au AS (SELECT variant, sum(pos * (below + 0.5::DOUBLE * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auroc FROM k GROUP BY variant),
abl AS (SELECT variant, round(auroc, 4) AS auroc, round(tp / np, 4) AS recall, round(fp / nn, 4) AS fpr FROM au JOIN q USING (variant))"""


@query(f"WITH {_ABL} SELECT variant, auroc, recall, fpr, row_number() OVER (ORDER BY auroc DESC, variant) AS place FROM abl")
def ablation_ranking(spark, sf_dir):
    rows = _ablations(spark, sf_dir).select("variant", *(F.round(c, 4).alias(c) for c in ("auroc", "recall", "fpr")))
    from pyspark.sql import Window as W

    return rows.withColumn("place", F.row_number().over(W.orderBy(F.col("auroc").desc(), "variant")))  # a row for each variant


@query(f"WITH {_ABL} SELECT max_by(variant, (auroc, -ascii(variant))) AS best, max(auroc) AS auroc FROM abl WHERE variant IN ('V3_full', 'equal', 'without_latent')")
def best_variant(spark, sf_dir):
    rows = _ablations(spark, sf_dir).select("variant", F.round("auroc", 4).alias("auroc")).where(F.col("variant").isin("V3_full", "equal", "without_latent"))
    return rows.agg(F.max_by("variant", F.struct("auroc", -F.ascii("variant"))).alias("best"), F.max("auroc").alias("auroc"))


_METRICS = ("auroc", "recall", "fpr")


@query(f"""WITH {_ABL}, un AS (""" + " UNION ALL ".join(f"SELECT variant, '{m}' AS metric, {m} AS value FROM abl" for m in _METRICS) + """)
SELECT a.metric, a.value AS first, b.value AS second, round(b.value - a.value, 4) AS delta FROM un a JOIN un b USING (metric) WHERE a.variant = 'V3_full' AND b.variant = 'equal'""")
def variant_delta(spark, sf_dir):
    rows = _ablations(spark, sf_dir).select("variant", *(F.round(c, 4).alias(c) for c in _METRICS)).unpivot("variant", list(_METRICS), "metric", "value")
    one = lambda v, name: rows.where(F.col("variant") == v).select("metric", F.col("value").alias(name))
    return one("V3_full", "first").join(one("equal", "second"), "metric").withColumn("delta", F.round(F.col("second") - F.col("first"), 4))


_EXPL = ", ".join(f"{{'c': {w!r} * z_{b}, 'i': {-i}, 'b': '{b}'}}" for i, (b, w) in enumerate(zip(B, X.WEIGHTS["V3_full"], strict=True)))


@query(f"WITH {_ZC}, e AS (SELECT list_reverse(list_sort([{_EXPL}])) AS l FROM z) SELECT l[1].b || ' and ' || l[2].b AS explanation, count(*) AS n FROM e GROUP BY 1")
def explain_top2(spark, sf_dir):
    return _clipped(spark, sf_dir).groupBy(X.explain().alias("explanation")).agg(F.count(F.lit(1)).alias("n"))


_V3 = " + ".join(f"{w!r} * z_{b}" for b, w in zip(B, X.WEIGHTS["V3_full"], strict=True))


@query(f"WITH {_ZC}, f AS (SELECT base_id, line, y, {_V3} AS score FROM z), t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM f WHERE y = 0) SELECT base_id, line, round(score, 6) AS score FROM f, t WHERE score > threshold")
def flag_scored_rows(spark, sf_dir):
    rows = _clipped(spark, sf_dir).withColumn("score", X.weighted(X.WEIGHTS["V3_full"]))
    return X.flag(rows, X.thresholds(rows.where("y = 0"), [], 0.99), []).where("flagged").select("base_id", "line", r("score"))


@query(f"WITH {BRANCHES_SQL}, {_HALVES} SELECT half, count(DISTINCT split_group_id) AS groups, count(*) AS rows FROM b JOIN h USING (split_group_id) GROUP BY half")
def hash_half_split(spark, sf_dir):
    rows = branch_scores(spark, sf_dir)
    return rows.join(hash_halves(rows, "split_group_id"), "split_group_id").groupBy("half").agg(F.count_distinct("split_group_id").alias("groups"), F.count(F.lit(1)).alias("rows"))


@query(f"WITH {BRANCHES_SQL} SELECT split_group_id, round(quantile_cont(semantic, 0.5), 6) AS median, round(quantile_disc(semantic, 0.5), 6) AS lower FROM b GROUP BY split_group_id")
def two_medians(spark, sf_dir):
    return quantiles(branch_scores(spark, sf_dir), ["split_group_id"], {"median": ("semantic", 0.5), "lower": ("semantic", 0.5, "lower")}).select("split_group_id", r("median"), r("lower"))


@query(f"WITH {BRANCHES_SQL} SELECT count(*) AS n, count(*) FILTER (" + " AND ".join(f"isfinite({b})" for b in B) + ") AS finite FROM b")
def finite_scores(spark, sf_dir):
    from ..functions.robust import finite

    every = reduce(lambda a, b: a & b, (finite(F.col(b)) for b in B))
    return branch_scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(every).alias("finite"))


@query("SELECT s_suppkey AS case_id, CAST('0x' || substr(sha256('42:' || CAST(s_suppkey AS VARCHAR) || ':stripes'), 1, 8) AS BIGINT) AS seed FROM supplier")
def case_seed(spark, sf_dir):
    from ..functions.keys import seed
    from ..sources.fixtures import table

    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), seed(F.concat(F.lit("42:"), F.col("s_suppkey").cast("string"), F.lit(":stripes"))).alias("seed"))


