"""Neighbours, memory banks, moments and latent distances over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as X
from ..sources.fixtures import table
from . import query


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_KNN = f"""d AS (SELECT a.vec_id AS id, b.vec_id AS other, 1 - least(greatest({_DOT}, -1), 1) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d QUALIFY rank <= 5)"""


def _knn(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return X.cosine_knn(rows, rows, "vec_id", "embedding", 5)


@query(f"WITH {_KNN} SELECT id, round(avg(distance), 6) AS distance FROM k GROUP BY id")
def cosine_knn_top5(spark, sf_dir):
    return _knn(spark, sf_dir).groupBy("id").agg(F.round(F.avg("distance"), 6).alias("distance"))


@query(f"WITH {_KNN} SELECT id, other, CAST(rank AS INT) AS rank FROM k")
def nearest_pairs(spark, sf_dir):
    return _knn(spark, sf_dir).select("id", "other", "rank")


@query(f"WITH {_KNN}, m AS (SELECT id, avg(distance) AS s FROM k GROUP BY id), g AS (SELECT label, list_reverse(list_sort(list(s))) AS l FROM m JOIN embeddings ON vec_id = id GROUP BY label) SELECT label, round(list_avg(l[1:greatest(1, CAST(ceil(len(l) * 0.05 - 1e-9) AS INT))]), 6) AS score FROM g")
def semantic_score_top5pct(spark, sf_dir):
    scores = _knn(spark, sf_dir).groupBy("id").agg(F.avg("distance").alias("s"))
    own = scores.join(_rows(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), "id")
    return own.groupBy("label").agg(F.round(X.top_mean(F.collect_list("s"), 0.05, "ceil"), 6).alias("score"))


@query("SELECT vec_id, round(list_avg(list_reverse(list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))))[1:4]), 6) AS up, round(list_avg(list_reverse(list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))))[1:3]), 6) AS down FROM embeddings")
def top_fraction_mean(spark, sf_dir):
    # 5 % of 64 elements: 4 rounded up, 3 rounded down
    return _rows(spark, sf_dir).select("vec_id", F.round(X.top_mean(F.col("embedding"), 0.05, "ceil"), 6).alias("up"), F.round(X.top_mean(F.col("embedding"), 0.05, "floor"), 6).alias("down"))


_PLACE = "p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42' || CAST(vec_id AS VARCHAR)), vec_id) AS place FROM embeddings)"


@query(f"WITH {_PLACE} SELECT vec_id, label, CAST(place AS INT) AS place FROM p WHERE place <= 8")
def memory_bank_quota(spark, sf_dir):
    return X.memory_quota(_rows(spark, sf_dir), "label", "vec_id", 8).select("vec_id", "label", "place")


@query(f"WITH {_PLACE} SELECT vec_id, label FROM p ORDER BY place, label, vec_id LIMIT 64")
def balanced_memory(spark, sf_dir):
    return X.balanced_memory(_rows(spark, sf_dir), "label", "vec_id", 64).select("vec_id", "label")


_EL = "e AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"


@query(f"WITH {_EL}, m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label, CAST(i AS INT) AS i, round(m / n, 6) + 0.0 AS v FROM m JOIN n USING (label)")
def global_features(spark, sf_dir):
    return X.global_feature(_rows(spark, sf_dir), "label", "embedding").select("label", F.posexplode("feature").alias("i", "v")).select("label", "i", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {_EL} SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS covariance FROM e a JOIN e b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i")
def covariance_matrix(spark, sf_dir):
    return X.moments(_rows(spark, sf_dir), "embedding").select("i", "j", (F.round("covariance", 6) + 0.0).alias("covariance"))


@query()
def mahalanobis(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return X.score_latent(rows, "vec_id", "embedding", X.fit_latent(rows, "embedding", 16)).select("vec_id", F.round("latent", 6).alias("latent"))


#: The inverse of the shrunken covariance of all 64 elements by elimination, a row and an identity's row side by side.
_INVERSE = f"""{_EL}, mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM e GROUP BY i)),
cv AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS c FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i), tau AS (SELECT greatest(sum(c) / 64, 1e-8) AS tau FROM cv WHERE i = j),
ro AS (SELECT i, list(0.9 * c + CASE WHEN i = j THEN 0.1 * tau ELSE 0 END ORDER BY j) || list_transform(range(64), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0 END) AS r FROM cv, tau GROUP BY i),
st AS (SELECT 0 AS k, (SELECT list(r ORDER BY i) FROM ro) AS m
  UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM st WHERE k < 64),
inv AS (SELECT list_transform(m, lambda r: r[65:128]) AS inv FROM st WHERE k = 64)"""


@query(f"""WITH RECURSIVE {_INVERSE}, c AS (SELECT vec_id, list_transform(list_zip(embedding, mu), lambda z: CAST(z[1] AS DOUBLE) - z[2]) AS c FROM embeddings, mu)
SELECT vec_id, round(sqrt(list_dot_product(c, list_transform(inv, lambda r: list_dot_product(r, c)))), 6) AS latent FROM c, inv""")
def mahalanobis_all(spark, sf_dir):
    # with all components the distance is that of the whole shrunken covariance
    rows = _rows(spark, sf_dir)
    return X.score_latent(rows, "vec_id", "embedding", X.fit_latent(rows, "embedding", 64)).select("vec_id", F.round("latent", 6).alias("latent"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.round(F.sqrt(X.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))
