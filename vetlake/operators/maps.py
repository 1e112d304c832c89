"""Score maps of images: windows' spectra, discrepancies between an image and what a generator makes of it, semantic maps.

The functions on arrays take a batch of images (n, side, side) in double precision; `image_table` and `pair_table` run them
over Arrow batches, so a batch is all that a worker holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD
from .patches import BANDS, _directional, _peaks
from .selection import quantiles

WINDOWS = (8, 16, 32)
FEATURES = ("band_low", "band_middle", "band_high", "gradient_x", "gradient_y", "anisotropy", "std", "mean")


def to_unit(values: F.Column) -> F.Column:
    """Bytes 0 to 255 as doubles 0 to 1."""
    return F.transform(values, lambda x: x.cast("double") / 255.0)


def to_bytes(values: F.Column) -> F.Column:
    """Doubles 0 to 1 as bytes 0 to 255, cut and rounded."""
    return F.transform(values, lambda x: F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def resize(x: np.ndarray, side: int, how: str = "bilinear") -> np.ndarray:
    """Images at another size, sampled at pixel centres; edges repeat."""
    n = x.shape[1]
    if how not in ("bilinear", "nearest"):
        raise ValueError(f"unknown way {how}")
    if n == side:
        return x
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    if how == "nearest":
        near = np.minimum((np.arange(side) * n) // side, n - 1)
        return x[:, near][:, :, near]
    lo = np.floor(at).astype(int)
    hi, w = np.minimum(lo + 1, n - 1), at - lo
    x = x[:, lo] * (1 - w)[None, :, None] + x[:, hi] * w[None, :, None]
    return x[:, :, lo] * (1 - w) + x[:, :, hi] * w


def box(x: np.ndarray, k: int) -> np.ndarray:
    """The mean over k x k around each pixel, with zeros beyond the edge that count."""
    h = k // 2
    total = np.pad(np.pad(x, ((0, 0), (h, h), (h, h))).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    n = x.shape[1]
    return (total[:, k : k + n, k : k + n] - total[:, :n, k : k + n] - total[:, k : k + n, :n] + total[:, :n, :n]) / (k * k)


def top_fraction(x: np.ndarray, fraction: float, rounding: str = "ceil") -> np.ndarray:
    """Each image's mean over its largest pixels."""
    flat = np.sort(x.reshape(len(x), -1), 1)
    k = max(1, int(np.ceil(flat.shape[1] * fraction - 1e-9)) if rounding == "ceil" else int(flat.shape[1] * fraction + 1e-9))
    return flat[:, -k:].mean(1)


def window_features(x: np.ndarray, w: int) -> np.ndarray:
    """(n, rows, columns, 8): FEATURES of each w x w tile, of images first brought to the next smaller multiple of w (or to w)."""
    side = max(w, x.shape[1] // w * w)
    x = resize(x, side)
    tiles = x.reshape(len(x), side // w, w, side // w, w).transpose(0, 1, 3, 2, 4)
    power = np.abs(np.fft.fft2(tiles)) ** 2 / (w * w)
    radius = np.hypot(*np.meshgrid(np.fft.fftfreq(w), np.fft.fftfreq(w), indexing="ij"))
    rings = [(radius > lo) & (radius <= hi) for lo, hi in BANDS]
    bands = [np.log1p(100 * power[..., ring].sum(-1) / max(1, ring.sum())) for ring in rings]  # an empty band has no energy
    dx, dy = (np.diff(tiles, axis=-1) ** 2).mean((-1, -2)), (np.diff(tiles, axis=-2) ** 2).mean((-1, -2))
    return np.stack([*bands, np.log1p(100 * dx), np.log1p(100 * dy), (dx - dy) / (dx + dy + 1e-5), tiles.std((-1, -2), ddof=1), tiles.mean((-1, -2))], -1)


def local_energy(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), "reflect")
    lap = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * x
    return box(lap**2, 9)


def profile_map(observed: np.ndarray, generated: np.ndarray) -> np.ndarray:
    d = observed - generated
    return (np.abs(d.mean(2))[:, :, None] + np.abs(d.mean(1))[:, None, :]) / 2


def discrepancy(observed: np.ndarray, generated: np.ndarray, uncertainty: np.ndarray, observed_tokens: np.ndarray | None = None, generated_tokens: np.ndarray | None = None, fraction: float = 0.005) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """channel -> (scores, maps): pixel residuals damped by uncertainty, missing texture, tokens' distances where there are tokens,
    and spectra of profiles. Scores are means of the largest `fraction`."""
    if not observed.shape == generated.shape == uncertainty.shape:
        raise ValueError("images, reconstructions and uncertainties differ in shape")
    pixel = np.abs(observed - generated) / (1 + 4 * uncertainty)
    texture = np.maximum(0, np.log(local_energy(generated) + 1e-4) - np.log(local_energy(observed) + 1e-4))
    out = {"pixel": (top_fraction(pixel, fraction), pixel), "texture": (top_fraction(texture, fraction), texture)}
    if observed_tokens is not None:
        score, grid = semantic_discrepancy(observed_tokens, generated_tokens, fraction)
        out["semantic"] = (score, resize(grid, observed.shape[1]))
    spectral = np.abs(_directional(observed) - _directional(generated))
    return out | {"spectral": (top_fraction(spectral, fraction), profile_map(observed, generated))}


def semantic_discrepancy(observed: np.ndarray, generated: np.ndarray, fraction: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """(scores, maps) from matching tokens (n, patches, d): 1 - cosine, 0 at least, on the square grid of patches."""
    side = int(round(observed.shape[1] ** 0.5))
    if observed.shape != generated.shape or side * side != observed.shape[1]:
        raise ValueError("tokens differ in shape or are no square grid")
    unit = lambda t: t / np.maximum(np.linalg.norm(t, axis=2, keepdims=True), 1e-12)
    maps = np.maximum(0, 1 - (unit(observed) * unit(generated)).sum(2)).reshape(-1, side, side)
    return top_fraction(maps, fraction), maps


def refined(observed: np.ndarray, generated: np.ndarray, uncertainty: np.ndarray, frame: int = 4, fraction: float = 0.005) -> dict[str, np.ndarray]:
    """channel -> scores: local excess of the residual without a frame of pixels, missing texture, peaks that only the image has.

    Images that the frame would use up keep it; those of few bins have no peaks.
    """
    inner = np.s_[:, frame:-frame, frame:-frame] if observed.shape[1] > 2 * frame + 2 else np.s_[:]
    residual = np.abs(observed - generated) / (1 + 4 * uncertainty)
    excess = residual / (box(residual, 15) + 0.03)
    texture = np.maximum(0, np.log(local_energy(generated) + 1e-4) - np.log(local_energy(observed) + 1e-4))
    gain = np.maximum(0, _peaks(observed) - _peaks(generated)) if observed.shape[1] >= 6 else np.zeros((len(observed), 2, 1))
    return {"pixel": top_fraction(excess[inner], fraction), "texture": top_fraction(texture, fraction), "spectral": top_fraction(gain, fraction)}


def fused_map(scores: dict[str, float], maps: dict[str, np.ndarray], state: dict[str, tuple[float, float]], weights: dict[str, float]) -> np.ndarray:
    """One image's weighted map: each branch's map, or its score everywhere where it has none, as z by (median, scale), cut to 0 to 100."""
    shape = next(iter(maps.values())).shape
    return sum(weights[b] * np.clip((maps.get(b, np.full(shape, scores[b])) - state[b][0]) / state[b][1], 0, 100) for b in weights)


def training_masks(n: int, side: int, seed: int) -> np.ndarray:
    """n masks that hide a tenth of an image or more: one rectangle, several smaller ones, or where smooth noise is highest; by seed and number."""
    out = np.zeros((n, side, side), bool)
    for i in range(n):
        rng = np.random.default_rng((seed, i))
        share, kind = rng.uniform(0.1, 0.4), rng.integers(3)
        if kind == 2:
            noise = box(rng.normal(size=(1, side, side)), max(3, side // 8 | 1))[0]
            out[i] = noise >= np.quantile(noise, 1 - share)
            continue
        while out[i].mean() < 0.1:  # rectangles may overlap: more of them, until a tenth is hidden
            area = share * side * side / (1 if kind == 0 else 3)
            h = int(np.clip(round(np.sqrt(area * rng.uniform(0.5, 2))), 1, side))
            w = int(np.clip(round(area / h), 1, side))
            top, left = rng.integers(0, side - h + 1), rng.integers(0, side - w + 1)
            out[i, top : top + h, left : left + w] = True
    return out


def covering(side: int) -> np.ndarray:
    """Four complementary masks; each pixel is in one."""
    y, x = np.indices((side, side))
    q = max(1, side // 4)
    which = (y // q % 2) * 2 + x // q % 2
    return np.stack([which == k for k in range(4)])


Reconstructor = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def local_mean(x: np.ndarray, mask: np.ndarray, seed: int) -> np.ndarray:
    """A generator without a network: hidden pixels become the mean of visible ones nearby, with a little noise by the seed."""
    seen = np.broadcast_to(~mask, x.shape).astype(float)
    k = max(3, x.shape[1] // 4 | 1)
    mean = box(x * seen, k) / np.maximum(box(seen, k), 1e-6)
    return mean + np.random.default_rng(seed).normal(0, 1e-3, x.shape[1:])


def reconstruct(x: np.ndarray, generator: Reconstructor = local_mean, seeds: tuple[int, ...] = (1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """(mean over seeds, standard deviation over seeds): each pixel is made while one of four masks hides it."""
    made = []
    for s in seeds:
        out = np.zeros_like(x)
        for k, mask in enumerate(covering(x.shape[1])):
            out[:, mask] = generator(x, mask, s * 4 + k)[:, mask]
        made.append(out)
    return np.mean(made, 0), np.std(made, 0)


def image_table(rows: DataFrame, key: str, vector: str, f: Callable[[np.ndarray], dict[str, np.ndarray]], columns: dict[str, str]) -> DataFrame:
    """key and f's columns (name -> type) of each image; images are square, row-major arrays of one size. Null images are left out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                side = int(round(flat.shape[1] ** 0.5))
                made = f(flat.reshape(-1, side, side))
                yield pa.record_batch([batch.column(0), *(pa.array(made[c].tolist()) for c in columns)], [key, *columns])

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{c} {t}" for c, t in columns.items())]))


def score_frame(rows: DataFrame, key: str, vector: str, engine: Callable[[np.ndarray], dict[str, np.ndarray]], branches: tuple[str, ...]) -> DataFrame:
    """rows with one double for each branch, which the engine makes of a batch of images; rows without an image have null scores."""
    scores = image_table(rows, key, vector, engine, dict.fromkeys(branches, "double"))
    return rows.join(scores, key, "left")


def generative_scores(x: np.ndarray) -> dict[str, np.ndarray]:
    """An engine for score_frame: three channels against the local-mean reconstruction."""
    made, spread = reconstruct(x)
    return {name: s for name, (s, _) in discrepancy(x, made, spread).items()}


def refined_scores(x: np.ndarray) -> dict[str, np.ndarray]:
    made, spread = reconstruct(x)
    return refined(x, made, spread)


def feature_rows(rows: DataFrame, key: str, vector: str, w: int) -> DataFrame:
    """key, tile, and FEATURES of each w x w tile."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                side = int(round(flat.shape[1] ** 0.5))
                made = window_features(flat.reshape(-1, side, side), w)
                n, tiles = len(made), made.shape[1] * made.shape[2]
                own = batch.column(0).take(pa.array(np.repeat(np.arange(n), tiles)))
                yield pa.record_batch([own, pa.array(np.tile(np.arange(tiles), n)), *(pa.array(c) for c in made.reshape(-1, 8).T)], [key, "tile", *FEATURES])

    kind = dict(rows.dtypes)[key]
    schema = ", ".join([f"{key} {kind}", "tile long", *(f"{c} double" for c in FEATURES)])
    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


def fit_spectral(rows: DataFrame) -> DataFrame:
    """One row: lower medians and scales (0.01 at least) of the tiles' features."""
    first = quantiles(rows, [], {f"median_{c}": (c, 0.5, "lower") for c in FEATURES})
    gone = rows.crossJoin(F.broadcast(first)).select(*(F.abs(F.col(c) - F.col(f"median_{c}")).alias(c) for c in FEATURES))  # one row
    mads = quantiles(gone, [], {c: (c, 0.5, "lower") for c in FEATURES})
    return first.crossJoin(mads.select(*(F.greatest(MAD * F.col(c), F.lit(0.01)).alias(f"scale_{c}") for c in FEATURES)))


def score_spectral(rows: DataFrame, key: str, vector: str, states: dict[int, dict], side: int, fraction: float = 0.05) -> DataFrame:
    """key and `spectral`: mean absolute z (100 at most) of each window size's tiles, brought to `side`, averaged over sizes; then the mean of the largest 5 %, rounded down."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        maps = []
        for w, s in states.items():
            z = np.abs((window_features(x, w) - np.array([s[f"median_{c}"] for c in FEATURES])) / np.array([s[f"scale_{c}"] for c in FEATURES]))
            maps.append(resize(np.minimum(z, 100).mean(-1), side))
        return {"spectral": top_fraction(np.mean(maps, 0), fraction, "floor")}

    return image_table(rows, key, vector, f, {"spectral": "double"})


def semantic_map(distances: DataFrame, image: str, patch: str, side: int, size: int, fraction: float = 0.05) -> DataFrame:
    """image and `semantic`: a grid of patches' distances brought to `size`, and the mean of the largest patches, rounded up.

    Distances are rows (image, patch, distance), patches numbered row-major from 0; missing ones have the distance 0.
    """
    known = F.map_from_entries(F.collect_list(F.struct(F.col(patch).cast("int"), "distance")))  # side * side entries
    grids = distances.groupBy(image).agg(known.alias("known"))
    grids = grids.select(image, F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.element_at("known", i), F.lit(0.0))).alias("grid"))
    return image_table(grids, image, "grid", lambda x: {"semantic": top_fraction(x, fraction), "map": resize(x, size).reshape(len(x), -1)}, {"semantic": "double", "map": "array<double>"})
