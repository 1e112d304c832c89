"""Pixel maps, filters, spectra, masks, localization and corruptions over embeddings as 8 x 8 images."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import corrupt as C
from ..operators import maps as T
from ..operators import metrics as M
from ..operators import patches as P
from ..operators.selection import quantiles
from ..sources.fixtures import PIXELS, pixels, table
from . import query


def r(c: str):
    return F.round(c, 6).alias(c)


@query(f"WITH {PIXELS} SELECT case_id, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std_pop, round(stddev_samp(v), 6) AS std_samp FROM px GROUP BY case_id")
def patch_stats(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("case_id").agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std_pop"), F.round(F.stddev_samp("v"), 6).alias("std_samp"))


_GRAD = f"{PIXELS}, g AS (SELECT *, lead(v) OVER (PARTITION BY case_id, y ORDER BY x) - v AS dx, lead(v) OVER (PARTITION BY case_id, x ORDER BY y) - v AS dy FROM px)"


@query(f"WITH {_GRAD} SELECT case_id, round(ln(1 + 100 * avg(dx * dx)), 6) AS gx, round(ln(1 + 100 * avg(dy * dy)), 6) AS gy FROM g GROUP BY case_id")
def patch_gradients(spark, sf_dir):
    g = P.gradients(pixels(spark, sf_dir))
    return g.groupBy("case_id").agg(F.round(F.log1p(100 * F.avg(F.col("dx") ** 2)), 6).alias("gx"), F.round(F.log1p(100 * F.avg(F.col("dy") ** 2)), 6).alias("gy"))


@query(f"WITH {_GRAD}, a AS (SELECT case_id, avg(dx * dx) AS dx, avg(dy * dy) AS dy FROM g GROUP BY case_id) SELECT case_id, round((dx - dy) / (dx + dy + 1e-5), 6) AS anisotropy FROM a")
def anisotropy(spark, sf_dir):
    a = P.gradients(pixels(spark, sf_dir)).groupBy("case_id").agg(F.avg(F.col("dx") ** 2).alias("dx"), F.avg(F.col("dy") ** 2).alias("dy"))
    return a.select("case_id", F.round((F.col("dx") - F.col("dy")) / (F.col("dx") + F.col("dy") + 1e-5), 6).alias("anisotropy"))


@query(f"""WITH {PIXELS}, f AS (SELECT case_id, ky, kx, pow(sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)), 2) AS e
FROM px, (SELECT unnest(range(8)) AS ky), (SELECT unnest(range(8)) AS kx) GROUP BY case_id, ky, kx),
q AS (SELECT case_id, e / 64 AS e, sqrt(pow(least(ky, 8 - ky) / 8, 2) + pow(least(kx, 8 - kx) / 8, 2)) AS radius FROM f)
SELECT case_id AS vec_id, round(ln(1 + 100 * avg(e) FILTER (radius > 0 AND radius <= 0.18)), 6) AS band_low,
round(ln(1 + 100 * avg(e) FILTER (radius > 0.18 AND radius <= 0.36)), 6) AS band_middle, round(ln(1 + 100 * avg(e) FILTER (radius > 0.36 AND radius <= 0.72)), 6) AS band_high FROM q GROUP BY case_id""")
def spectral_bands(spark, sf_dir):
    return P.spectral_bands(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", r("band_low"), r("band_middle"), r("band_high"))


_POWER = f"""{PIXELS}, pr AS (SELECT case_id, 0 AS axis, y AS n, avg(v) AS m FROM px GROUP BY case_id, y UNION ALL SELECT case_id, 1, x, avg(v) FROM px GROUP BY case_id, x),
pc AS (SELECT case_id, axis, n, (m - avg(m) OVER (PARTITION BY case_id, axis)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 8)) AS p FROM pr),
pw AS (SELECT case_id, axis, k, (pow(sum(p * cos(2 * pi() * k * n / 8)), 2) + pow(sum(p * sin(2 * pi() * k * n / 8)), 2)) / 8 AS w FROM pc, (SELECT unnest(range(5)) AS k) GROUP BY case_id, axis, k)"""


@query(f"WITH {_POWER} SELECT case_id AS vec_id, CAST(axis AS INT) AS axis, CAST(k AS INT) AS k, round(ln(1 + 100 * w), 6) + 0.0 AS power FROM pw WHERE k > 0")
def directional_power(spark, sf_dir):
    made = P.directional_power(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    each = lambda name, axis: made.select("vec_id", F.lit(axis).alias("axis"), F.posexplode(name).alias("k", "power"))
    return each("row_power", 0).unionAll(each("column_power", 1)).select("vec_id", "axis", (F.col("k") + 1).alias("k"), (F.round("power", 6) + 0.0).alias("power"))


@query(f"""WITH {_POWER}, t AS (SELECT *, ln(1 + w / ((sum(w) OVER (PARTITION BY case_id, axis) - w) / 8 + 1e-4)) AS peak FROM pw)
SELECT case_id AS vec_id, round(max(peak) FILTER (axis = 0), 6) AS row_peak, round(max(peak) FILTER (axis = 1), 6) AS column_peak FROM t WHERE k >= 3 GROUP BY case_id""")
def frequency_peaks(spark, sf_dir):
    return P.frequency_peaks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", r("row_peak"), r("column_peak"))


def _box_sql(k: int, value: str, out: str, source: str) -> str:
    h = k // 2
    return f"""{out}_r AS (SELECT *, sum({value}) OVER (PARTITION BY case_id, y ORDER BY x ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS r_{out} FROM {source}),
{out}_t AS (SELECT *, sum(r_{out}) OVER (PARTITION BY case_id, x ORDER BY y ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) / {k * k} AS {out} FROM {out}_r)"""


@query(f"WITH {PIXELS}, {_box_sql(9, 'v', 'box', 'px')} SELECT case_id, y, x, round(box, 6) + 0.0 AS box FROM box_t")
def box_filter(spark, sf_dir):
    return P.box_mean(pixels(spark, sf_dir), 9).select("case_id", "y", "x", (F.round("box", 6) + 0.0).alias("box"))


_LAP = """SELECT *, coalesce(lag(v) OVER a, lead(v) OVER a) + coalesce(lead(v) OVER a, lag(v) OVER a) + coalesce(lag(v) OVER b, lead(v) OVER b) + coalesce(lead(v) OVER b, lag(v) OVER b) - 4 * v AS lap FROM px
WINDOW a AS (PARTITION BY case_id, y ORDER BY x), b AS (PARTITION BY case_id, x ORDER BY y)"""


@query(f"WITH {PIXELS}, l AS ({_LAP}), q AS (SELECT *, lap * lap AS e FROM l), {_box_sql(9, 'e', 'energy', 'q')} SELECT case_id, round(avg(energy), 6) AS energy FROM energy_t GROUP BY case_id")
def laplacian_energy(spark, sf_dir):
    px = P.laplacian(pixels(spark, sf_dir)).withColumn("e", F.col("laplacian") * F.col("laplacian"))
    return P.box_mean(px, 9, "e", "energy").groupBy("case_id").agg(F.round(F.avg("energy"), 6).alias("energy"))


_PAIR = f"{PIXELS}, gen AS (SELECT class_id, y, x, avg(v) AS g FROM px GROUP BY class_id, y, x), o AS (SELECT px.*, g FROM px JOIN gen USING (class_id, y, x))"


def observed(spark, sf_dir):
    """Each image with its class's mean image as what a generator would have made of it."""
    px = pixels(spark, sf_dir)
    return px.join(px.groupBy("class_id", "y", "x").agg(F.avg("v").alias("g")), ["class_id", "y", "x"])


@query(f"""WITH {_PAIR}, l AS (SELECT *, coalesce(lag(v) OVER a, lead(v) OVER a) + coalesce(lead(v) OVER a, lag(v) OVER a) + coalesce(lag(v) OVER b, lead(v) OVER b) + coalesce(lead(v) OVER b, lag(v) OVER b) - 4 * v AS lo,
coalesce(lag(g) OVER a, lead(g) OVER a) + coalesce(lead(g) OVER a, lag(g) OVER a) + coalesce(lag(g) OVER b, lead(g) OVER b) + coalesce(lead(g) OVER b, lag(g) OVER b) - 4 * g AS lg FROM o
WINDOW a AS (PARTITION BY case_id, y ORDER BY x), b AS (PARTITION BY case_id, x ORDER BY y)), q AS (SELECT *, lo * lo AS eo, lg * lg AS eg FROM l),
{_box_sql(9, 'eo', 'bo', 'q')}, {_box_sql(9, 'eg', 'bg', 'bo_t')} SELECT case_id, round(avg(greatest(0, ln(bg + 1e-4) - ln(bo + 1e-4))), 6) AS deficit FROM bg_t GROUP BY case_id""")
def texture_deficit(spark, sf_dir):
    px = P.laplacian(P.laplacian(observed(spark, sf_dir), "v", "lo"), "g", "lg").withColumns({"eo": F.col("lo") * F.col("lo"), "eg": F.col("lg") * F.col("lg")})
    px = P.box_mean(P.box_mean(px, 9, "eo", "bo"), 9, "eg", "bg")
    gap = F.greatest(F.lit(0.0), F.log(F.col("bg") + 1e-4) - F.log(F.col("bo") + 1e-4))
    return px.groupBy("case_id").agg(F.round(F.avg(gap), 6).alias("deficit"))


@query(f"WITH {_PAIR} SELECT case_id, round(avg(abs(v - g) / (1 + 4 * abs(g))), 6) AS residual FROM o GROUP BY case_id")
def pixel_residual(spark, sf_dir):
    return observed(spark, sf_dir).groupBy("case_id").agg(F.round(F.avg(P.residual(F.col("v"), F.col("g"), F.abs("g"))), 6).alias("residual"))


@query(f"WITH {_PAIR}, q AS (SELECT *, abs(v - g) AS d FROM o), {_box_sql(15, 'd', 'near', 'q')} SELECT case_id, round(max(d / (near + 0.03)), 6) AS excess FROM near_t GROUP BY case_id")
def local_residual(spark, sf_dir):
    px = P.box_mean(observed(spark, sf_dir).withColumn("d", F.abs(F.col("v") - F.col("g"))), 15, "d", "near")
    return px.groupBy("case_id").agg(F.round(F.max(F.col("d") / (F.col("near") + 0.03)), 6).alias("excess"))


@query(f"""WITH {_PAIR}, p AS (SELECT *, avg(v - g) OVER (PARTITION BY case_id, y) AS rr, avg(v - g) OVER (PARTITION BY case_id, x) AS cc FROM o)
SELECT case_id, y, x, round((abs(rr) + abs(cc)) / 2, 6) AS profile FROM p""")
def profile_map(spark, sf_dir):
    px = P.profiles(observed(spark, sf_dir).withColumn("d", F.col("v") - F.col("g")), "d")
    return px.select("case_id", "y", "x", F.round((F.abs("row_mean") + F.abs("column_mean")) / 2, 6).alias("profile"))


# the mask that stands for a corruption: the central 4 x 4; the map: the residual
_MASKED = f"{_PAIR}, q AS (SELECT *, abs(v - g) AS score, CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN 1 ELSE 0 END AS m FROM o)"


def _masked(spark, sf_dir):
    inside = F.col("y").between(2, 5) & F.col("x").between(2, 5)
    # the pixel's row is y: the label of the metrics takes that name only after it is no longer needed
    return observed(spark, sf_dir).select("case_id", "class_id", F.col("y").alias("row"), "x", F.abs(F.col("v") - F.col("g")).alias("score"), inside.cast("int").alias("y"))


@query(f"""WITH {_MASKED}, c AS (SELECT case_id, score, sum(m) AS pos, sum(1 - m) AS neg FROM q GROUP BY case_id, score),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY case_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT case_id, round(sum(pos * (below + 0.5::DOUBLE * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS pixel_auroc FROM k GROUP BY case_id""")
def pixel_auc(spark, sf_dir):
    return M.rank_auroc(_masked(spark, sf_dir), ["case_id"]).select("case_id", F.round("auroc", 6).alias("pixel_auroc"))


_LIMIT = "t AS (SELECT quantile_cont(score, 0.95) AS limit_ FROM q WHERE class_id = 0)"


def _limit(rows):
    return quantiles(rows.where("class_id = 0"), [], {"limit_": ("score", 0.95)})


@query(f"""WITH {_MASKED}, {_LIMIT} SELECT case_id, round(count(*) FILTER (m = 1 AND score > limit_) / nullif(count(*) FILTER (m = 1 OR score > limit_), 0), 6) AS iou,
round((avg(CASE WHEN m = 1 THEN score END) + 1e-6) / (avg(CASE WHEN m = 0 THEN score END) + 1e-6), 6) AS inside_outside_ratio FROM q, t GROUP BY case_id""")
def iou_ratio(spark, sf_dir):
    rows = _masked(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(_limit(rows)))  # one row
    hit, inside = F.col("score") > F.col("limit_"), F.col("y") == 1
    mean = lambda c: F.avg(F.when(c, F.col("score"))) + 1e-6
    return rows.groupBy("case_id").agg(
        F.round(F.count_if(hit & inside) / F.nullif(F.count_if(hit | inside), F.lit(0)), 6).alias("iou"),
        F.round(mean(inside) / mean(~inside), 6).alias("inside_outside_ratio"),
    )


@query(f"""WITH {_MASKED}, a AS (SELECT quantile_cont(score, 0.5) AS med FROM q WHERE class_id < 5), d AS (SELECT greatest(1.4826 * quantile_cont(abs(score - med), 0.5), 1e-6) AS s FROM q, a WHERE class_id < 5)
SELECT round(quantile_cont((score - med) / s, 0.95), 6) AS threshold, count(*) AS n FROM q, a, d WHERE class_id >= 5 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6""")
def map_calibration(spark, sf_dir):
    from ..operators import fusion as X

    rows = _masked(spark, sf_dir)
    state = X.fit(rows.where("class_id < 5"), ["score"], "most")
    b = rows.where("class_id >= 5 and row between 1 and 6 and x between 1 and 6")
    limit = quantiles(X.with_z(b, state, ["score"]), [], {"threshold": ("z_score", 0.95)})
    return limit.select(F.round("threshold", 6).alias("threshold")).crossJoin(b.agg(F.count(F.lit(1)).alias("n")))  # one row each


@query(f"WITH {_MASKED}, {_LIMIT}, c AS (SELECT case_id, class_id, count(*) FILTER (m = 1 AND score > limit_) / nullif(count(*) FILTER (score > limit_), 0) AS hit FROM q, t GROUP BY case_id, class_id) SELECT class_id, count(*) AS n, round(avg(hit), 6) AS mean_hit FROM c GROUP BY class_id")
def localization_by_family(spark, sf_dir):
    rows = _masked(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(_limit(rows)))  # one row
    hit = F.col("score") > F.col("limit_")
    each = rows.groupBy("case_id", "class_id").agg((F.count_if(hit & (F.col("y") == 1)) / F.nullif(F.count_if(hit), F.lit(0))).alias("hit"))
    return each.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("mean_hit"))


@query(f"WITH {PIXELS} SELECT case_id, count(*) AS n, round(avg(v), 6) AS mean FROM px WHERE (8 * y + x) % 16 = 0 GROUP BY case_id")
def systematic_pixels(spark, sf_dir):
    # the operator under test is the systematic sample of pixels
    return pixels(spark, sf_dir).where((8 * F.col("y") + F.col("x")) % 16 == 0).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(f"WITH {PIXELS} SELECT case_id, round(quantile_cont(greatest(v, 0), 0.99), 6) AS range FROM px GROUP BY case_id")
def display_range(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("v", F.greatest(F.col("v"), F.lit(0.0)))
    return quantiles(rows, ["case_id"], {"range": ("v", 0.99)}).select("case_id", F.round("range", 6).alias("range"))


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(((y // 4) % 2) * 2 + (x // 4) % 2 AS INT) AS mask FROM (SELECT unnest(range(16)) AS y), (SELECT unnest(range(16)) AS x)")
def covering_masks(spark, sf_dir):
    grid = spark.range(256).select(F.floor(F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"))
    return grid.select("y", "x", P.covering_mask(F.col("y"), F.col("x"), 16).cast("int").alias("mask"))


STEPS = 50


@query(f"""WITH t AS (SELECT i, pow(cos((i / {STEPS}.0 + 0.008) / 1.008 * pi() / 2), 2) AS f FROM (SELECT unnest(range({STEPS} + 1)) AS i)),
b AS (SELECT i, greatest(least(1 - f / lag(f) OVER (ORDER BY i), 0.999), 1e-4) AS beta FROM t), c AS (SELECT i, exp(sum(ln(1 - beta)) OVER (ORDER BY i)) AS a FROM b WHERE i > 0)
SELECT CAST(i - 1 AS INT) AS step, round(a, 6) AS signal FROM c""")
def noise_schedule(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(P.noise_schedule(STEPS))), "step int, signal double").select("step", r("signal"))


def _corruption(name: str, kind: str, sql: str, box: tuple[int, int, int] | None = None) -> None:
    """A query of one kind at severity 0.3 in a fixed region; `sql` is a pixel's new value, from v, y, x, the case's seed and `at(y, x)`."""

    def f(spark, sf_dir):
        rows = C.cases(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [kind], [0.3], most_tries=1, box=box)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        return rows.select("vec_id", F.round(total("image") / 64, 6).alias("mean"), total("mask").cast("long").alias("changed"))

    at = re.sub(r"at\(([^,]*), ([^)]*)\)", r"vs[8 * (\1) + (\2) + 1]", sql)
    query(
        f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda z: least(greatest(CAST(z AS DOUBLE), 0), 1)) AS vs,
CAST('0x' || substr(sha256(CAST(vec_id AS VARCHAR) || '_{kind}_0.3_42'), 1, 8) AS BIGINT) AS seed FROM embeddings),
p AS (SELECT vec_id, vs, seed, i // 8 AS y, i % 8 AS x, vs[i + 1] AS v FROM (SELECT *, unnest(range(64)) AS i FROM e)),
o AS (SELECT vec_id, v, least(greatest({at}, 0), 1) AS c FROM p) SELECT vec_id, round(avg(c), 6) AS mean, count(*) FILTER (abs(c - v) > 1.0::DOUBLE / 255) AS changed FROM o GROUP BY vec_id""",
        name,
    )(f)


_BOX = "y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"
_corruption("corruption_clip", "clipping", "(v - 0.5::DOUBLE) * 2.8::DOUBLE + 0.5::DOUBLE")
_corruption("corruption_stripes", "stripes", "v + 0.255::DOUBLE * sin(2 * pi() * (CASE WHEN seed % 2 = 1 THEN x ELSE y END) / 8)")
_corruption("corruption_missing", "missing_crop", f"CASE WHEN {_BOX} THEN 1 - seed % 2 ELSE v END", (2, 2, 4))
_corruption("corruption_permutation", "block_permutation", f"CASE WHEN {_BOX} THEN CASE WHEN seed % 2 = 1 THEN at(y, 2 + x % 4) ELSE at(2 + y % 4, x) END ELSE v END", (2, 2, 4))
_corruption("corruption_duplicate", "patch_duplication", "CASE WHEN y >= 4 AND x >= 4 THEN at(y - 4, x - 4) ELSE v END", (4, 4, 4))
_corruption("corruption_tearing", "tearing", "CASE WHEN y BETWEEN 2 AND 3 THEN 0 WHEN y BETWEEN 4 AND 5 THEN at(y, x + CASE WHEN x < 2 THEN 6 ELSE -2 END) ELSE v END", (2, 2, 4))
_corruption("corruption_foreign", "foreign", f"CASE WHEN {_BOX} THEN ((y - 2) // 3 + (x - 2) // 3) % 2 ELSE v END", (2, 2, 4))


@query(f"""WITH {PIXELS}, b AS (SELECT case_id, y, x, round_even(255 * least(greatest(v, 0), 1), 0) AS v FROM px),
o AS (SELECT case_id, v, CASE WHEN {_BOX} THEN round_even(v * (1 - (0.3::DOUBLE + 0.7::DOUBLE * 0.3::DOUBLE)) + 255 * (((y - 2) // 3 + (x - 2) // 3) % 2) * (0.3::DOUBLE + 0.7::DOUBLE * 0.3::DOUBLE), 0) ELSE v END AS c FROM b)
SELECT case_id AS vec_id, round(avg(c) / 255, 6) AS mean, CAST(CASE WHEN bool_or(c <> v) THEN 16 ELSE 0 END AS BIGINT) AS masked FROM o GROUP BY case_id""")
def corruption_checker(spark, sf_dir):
    rows = C.cases(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["foreign_content"], [0.3], C.stress, box=(2, 2, 4))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(total("image") / 64, 6).alias("mean"), total("mask").cast("long").alias("masked"))


@query()
def corruption_random_families(spark, sf_dir):
    rows = C.cases(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", list(C.KINDS), [0.3])
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("changed_fraction"), 6).alias("changed"))


@query()
def stress_families(spark, sf_dir):
    rows = C.cases(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", C.STRESS, C.SEVERITIES, C.stress)
    return rows.groupBy("family", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "unchanged").alias("unchanged"), F.round(F.avg("changed_fraction"), 6).alias("masked"))


# ---- score maps: numpy over Arrow batches


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query()
def window_features(spark, sf_dir):
    rows = T.feature_rows(_embeddings(spark, sf_dir), "vec_id", "embedding", 4)
    return rows.groupBy("tile").agg(*(F.round(F.avg(c), 6).alias(c) for c in T.FEATURES))


@query(f"""WITH {_GRAD}, t AS (SELECT *, (y // 4) * 2 + x // 4 AS tile, x % 4 AS tx, y % 4 AS ty FROM g),
f AS (SELECT case_id, tile, avg(v) AS mean, stddev_samp(v) AS std, avg(dx * dx) FILTER (tx < 3) AS dx, avg(dy * dy) FILTER (ty < 3) AS dy FROM t GROUP BY case_id, tile)
SELECT CAST(tile AS BIGINT) AS tile, round(avg(mean), 6) + 0.0 AS mean, round(avg(std), 6) AS std, round(avg(ln(1 + 100 * dx)), 6) AS gradient_x, round(avg((dx - dy) / (dx + dy + 1e-5)), 6) + 0.0 AS anisotropy FROM f GROUP BY tile""")
def window_statistics(spark, sf_dir):
    rows = T.feature_rows(_embeddings(spark, sf_dir), "vec_id", "embedding", 4)
    return rows.groupBy("tile").agg((F.round(F.avg("mean"), 6) + 0.0).alias("mean"), F.round(F.avg("std"), 6).alias("std"), F.round(F.avg("gradient_x"), 6).alias("gradient_x"), (F.round(F.avg("anisotropy"), 6) + 0.0).alias("anisotropy"))


@query()
def spectral_scores(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    normal = rows.where("label < 5")
    states = {w: T.fit_spectral(T.feature_rows(normal, "vec_id", "embedding", w)).first().asDict() for w in (4, 8)}  # one row each
    return T.score_spectral(rows, "vec_id", "embedding", states, 8).select("vec_id", r("spectral"))


@query()
def generative_scores(spark, sf_dir):
    rows = T.score_frame(_embeddings(spark, sf_dir).select("vec_id", "label", "embedding"), "vec_id", "embedding", T.generative_scores, ("pixel", "texture", "spectral"))
    return rows.select("vec_id", "label", r("pixel"), r("texture"), r("spectral"))


@query()
def refined_scores(spark, sf_dir):
    return T.image_table(_embeddings(spark, sf_dir), "vec_id", "embedding", T.refined_scores, dict.fromkeys(("pixel", "texture", "spectral"), "double"))


@query()
def reconstruction_probe(spark, sf_dir):
    from ..operators.protocol import probe

    def f(x):
        made, spread = T.reconstruct(x)
        return {"o": x.reshape(len(x), -1), "g": made.reshape(len(x), -1), "u": spread.reshape(len(x), -1)}

    rows = T.image_table(_embeddings(spark, sf_dir), "vec_id", "embedding", f, dict.fromkeys("ogu", "array<double>"))
    return probe(rows, "o", "g", "u").select(r("residual_mae"), r("seed_disagreement"), "finite")


@query("""WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY label, i),
d AS (SELECT v.label, vec_id, 1 - greatest(least(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 1), -1) AS d FROM v JOIN c ON c.label = v.label AND c.i = v.i GROUP BY v.label, vec_id),
n AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS nth FROM d)
SELECT label, CAST(nth AS BIGINT) AS nth, round(greatest(max(d), CASE WHEN count(*) < 16 THEN 0 ELSE max(d) END), 6) AS semantic FROM n GROUP BY label, nth""")
def semantic_grid(spark, sf_dir):
    # every 16 vectors of a label are the patches of an image; their distances are those to the label's mean vector. 5 % of 16, rounded up, is one
    from pyspark.sql import Window as W

    from ..operators import vectors as V

    rows = _embeddings(spark, sf_dir)
    far = V.cosine_distance(V.unit(F.col("embedding")), F.col("feature"))
    rows = rows.join(V.global_feature(rows, "label", "embedding"), "label").select("label", "vec_id", far.alias("distance"))
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = rows.select(F.struct("label", F.floor(place / 16).alias("nth")).alias("image"), (place % 16).alias("patch"), "distance")
    rows = rows.select(F.to_json("image").alias("image"), "patch", "distance")
    made = T.semantic_map(rows, "image", "patch", 4, 8)
    own = F.from_json("image", "label long, nth long")
    return made.select(own.alias("i"), "semantic").select(F.col("i.label").cast("int").alias("label"), "i.nth", r("semantic"))


@query(f"WITH {_PAIR}, q AS (SELECT case_id, avg(v * v) AS e FROM o GROUP BY case_id) SELECT count(*) AS n, round(avg(e), 6) AS energy FROM q")
def image_energy(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("case_id").agg(F.avg(F.col("v") * F.col("v")).alias("e")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("energy"))
