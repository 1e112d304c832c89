"""Score maps, masks, reconstruction and the protocol of a run."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetlake.operators import maps as T
from vetlake.operators import patches as P
from vetlake.operators import protocol as R


@pytest.fixture(scope="module")
def images():
    return np.random.default_rng(1).random((5, 16, 16))


def test_bytes_round_trip(spark):
    df = spark.createDataFrame([([0, 1, 128, 255],), ([],), (None,)], "v array<int>")
    assert [r[0] for r in df.select(T.to_bytes(T.to_unit(F.col("v")))).collect()] == [[0, 1, 128, 255], [], None]


def test_resize():
    x = np.arange(16.0).reshape(1, 4, 4)
    assert (T.resize(x, 4) == x).all()
    assert T.resize(x, 2)[0].tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert T.resize(x, 8, "nearest")[0, :2, :2].tolist() == [[0, 0], [0, 0]]
    assert T.resize(x, 9).min() >= 0 and T.resize(x, 9).max() <= 15
    with pytest.raises(ValueError):
        T.resize(x, 2, "other")


@pytest.mark.parametrize("k", [3, 9, 15])
def test_box_divides_by_all_places(images, k):
    h = k // 2
    p = np.pad(images, ((0, 0), (h, h), (h, h)))
    want = np.stack([[p[:, i : i + k, j : j + k].sum((1, 2)) / (k * k) for j in range(16)] for i in range(16)]).transpose(2, 0, 1)
    assert np.allclose(T.box(images, k), want)


def test_top_fraction_rounds_as_told():
    x = np.arange(30.0).reshape(1, 5, 6)
    assert T.top_fraction(x, 0.05)[0] == 28.5 and T.top_fraction(x, 0.05, "floor")[0] == 29


def test_window_features(images):
    f = T.window_features(images, 8)
    tile = images[2, 8:16, :8]
    got = dict(zip(T.FEATURES, f[2, 1, 0]))
    assert f.shape == (5, 2, 2, 8)
    assert got["mean"] == pytest.approx(tile.mean()) and got["std"] == pytest.approx(tile.std(ddof=1))
    assert got["gradient_x"] == pytest.approx(np.log1p(100 * (np.diff(tile, axis=1) ** 2).mean()))
    assert np.isfinite(T.window_features(images, 4)).all()


def test_equal_images_do_not_differ(images):
    for scores, maps in T.discrepancy(images, images, np.zeros_like(images)).values():
        assert np.allclose(scores, 0) and np.allclose(maps, 0)
    assert all(np.allclose(s, 0) for n, s in T.refined(images, images, np.zeros_like(images)).items())
    with pytest.raises(ValueError):
        T.discrepancy(images, images[:, :8], images)


def test_missing_texture_is_one_sided(images):
    flat = np.full_like(images, 0.5)
    assert (T.discrepancy(flat, images, np.zeros_like(images))["texture"][0] > 1).all()
    assert np.allclose(T.discrepancy(images, flat, np.zeros_like(images))["texture"][0], 0)


def test_semantic_discrepancy():
    x = np.eye(4)[None].repeat(2, 0)
    scores, maps = T.semantic_discrepancy(x, x[:, ::-1], 0.5)
    assert scores.tolist() == [1, 1] and maps.shape == (2, 2, 2)
    with pytest.raises(ValueError):
        T.semantic_discrepancy(x[:, :3], x[:, :3])


def test_masks():
    masks = T.training_masks(20, 32, 7)
    assert (masks == T.training_masks(20, 32, 7)).all()
    assert all(0.095 < m.mean() <= 0.6 for m in masks)
    assert (T.covering(16).sum(0) == 1).all()


def test_reconstruction_never_sees_what_it_makes(images):
    other = images.copy()
    mask = T.covering(16)[0]
    other[:, mask] = 9
    a, b = T.reconstruct(images)[0], T.reconstruct(other)[0]
    assert np.allclose(a[:, mask], b[:, mask])
    mean, spread = T.reconstruct(images, seeds=(1, 2))
    assert spread.max() > 0 and (mean == T.reconstruct(images, seeds=(1, 2))[0]).all()


def test_score_frame_keeps_rows(spark, images):
    df = spark.createDataFrame([(i, x.ravel().tolist(), "k") for i, x in enumerate(images)] + [(9, None, "k")], "id long, v array<double>, label string")
    rows = {r["id"]: r for r in T.score_frame(df.repartition(3), "id", "v", T.generative_scores, ("pixel", "texture", "spectral")).collect()}
    want = T.generative_scores(images)
    assert rows[9]["pixel"] is None and len(rows) == 6
    assert [rows[i]["pixel"] for i in range(5)] == pytest.approx(want["pixel"].tolist())


def test_spectral_scores_see_an_odd_image(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.5, 0.05, (30, 16, 16))
    x[7] += 0.4 * np.sin(np.arange(16) * 2)[None, :]
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    states = {w: T.fit_spectral(T.feature_rows(df.where("id <> 7"), "id", "v", w)).first().asDict() for w in (8, 16)}
    rows = T.score_spectral(df, "id", "v", states, 16).collect()
    assert max(rows, key=lambda r: r["spectral"])["id"] == 7


def test_semantic_map(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(16)], "image string, patch int, distance double").repartition(4)
    row = T.semantic_map(df, "image", "patch", 4, 8).first()
    assert row["semantic"] == 15 and len(row["map"]) == 64


def test_protocol(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    assert R.load_config(spark, str(tmp_path / "c.json")) == {"a": 1}
    assert R.stale({"model_hashes": {"m": "x"}, "config": {"a": 1}}, {"m": "x"}, {"a": 1}) == []
    assert R.stale({"model_hashes": {"m": "x"}}, {"m": "y", "n": "z"}, {"a": 1}) == ["model m", "model n", "config a"]
    t = R.Timings()
    with t.stage("one"):
        pass
    assert set(t.seconds) == {"one"}
    rows = spark.createDataFrame([("train", "a", "s"), ("test", "a", "t"), ("test", "b", None)], "role string, k string, s string")
    got = {r["role"]: r.asDict() for r in R.report(rows, "role", ["k", "s"]).collect()}
    assert got["test"] == {"role": "test", "rows": 2, "n_k": 2, "n_s": 1, "violations": 2}


def test_gradients_are_mean_squares():
    x = np.array([[[0, 1, 3, 6]] * 4], float)
    f = dict(zip(T.FEATURES, T.window_features(x, 4)[0, 0, 0]))
    assert f["gradient_x"] == pytest.approx(np.log1p(100 * 14 / 3)) and f["gradient_y"] == 0
    assert f["anisotropy"] == pytest.approx((14 / 3) / (14 / 3 + 1e-5))


@pytest.mark.parametrize(("side", "tiles"), [(16, 2), (23, 2), (24, 3), (31, 3), (5, 1)])
def test_windows_take_the_smaller_multiple(side, tiles):
    assert T.window_features(np.zeros((1, side, side)), 8).shape == (1, tiles, tiles, 8)


def test_directional_power_is_orthonormal():
    n = 8
    x = np.repeat(np.arange(n, dtype=float)[:, None], n, 1)[None]  # rows' means 0 to 7, columns' means equal
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    p = (np.arange(n) - 3.5) * hann
    want = [abs(sum(p[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))) ** 2 / n for k in range(5)]
    assert np.allclose(P._power(x)[0, 0], want) and np.allclose(P._power(x)[0, 1], 0)
    assert np.allclose(P._directional(x)[0, 0], np.log1p(100 * np.array(want[1:])))
    peaks = [np.log1p(want[k] / ((sum(want) - want[k]) / 8 + 1e-4)) for k in (3, 4)]  # of all five bins the first three are left out
    assert np.allclose(P._peaks(x)[0, 0], peaks)


def test_channels_are_means_of_the_largest(images):
    made, spread, tokens = images[::-1], np.full_like(images, 0.1), np.random.default_rng(2).normal(size=(5, 16, 6))
    out = T.discrepancy(images, made, spread, tokens, 2 * tokens[::-1], fraction=0.5)
    assert list(out) == ["pixel", "texture", "semantic", "spectral"] and all(m.shape == images.shape for _, m in out.values())
    gap = np.sort(np.abs(P._directional(images) - P._directional(made)).reshape(5, -1), 1)[:, -8:]
    assert np.allclose(out["spectral"][0], gap.mean(1))
    cos = [[a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(x, y)] for x, y in zip(tokens, tokens[::-1])]
    far = np.sort(np.maximum(0, 1 - np.array(cos)), 1)
    assert np.allclose(out["semantic"][0], far[:, -8:].mean(1))
    assert T.semantic_discrepancy.__defaults__ == (0.005,)


def test_refined_crops_the_residual_only(images):
    made = images.copy()
    made[:, 0, 0] += 0.9  # in the frame
    out = T.refined(images, made, np.zeros_like(images))
    assert np.allclose(out["pixel"], 0) and (out["texture"] > 0).any()


def test_fused_map():
    got = T.fused_map({"a": 3.0, "b": 9.0}, {"a": np.array([[1.0, 500.0]])}, {"a": (1.0, 2.0), "b": (1.0, 4.0)}, {"a": 0.5, "b": 0.25})
    assert got.tolist() == [[0.5, 50.5]]


def test_run_folders_and_caches(spark, tmp_path):
    path = R.output_dir(spark, {"output": "outputs/x"}, f"file://{tmp_path}")
    assert (tmp_path / "outputs/x").is_dir() and path.endswith("/outputs/x") and R.output_dir(spark, {"output": "outputs/x"}, f"file://{tmp_path}") == path
    assert R.thread_caps({"threads": 3})["spark.executorEnv.OMP_NUM_THREADS"] == "3" and set(R.thread_caps({}).values()) == {"4"}
    for name in ("1:a:0.15.pt", "2.pt", "x.txt"):
        (tmp_path / name).write_text("-")
    done = R.cached(spark, f"file://{tmp_path}")
    jobs = spark.createDataFrame([("2",), ("3",)], "case_id string")
    assert sorted(r[0] for r in done.collect()) == ["1:a:0.15", "2"]
    assert [r[0] for r in R.pending(jobs, done, ["case_id"]).collect()] == ["3"]
