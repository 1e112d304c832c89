"""Pixel operators on tables (case_id, y, x, v), and spectra of small images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _line(case: str, along: str, across: str):
    return W.partitionBy(case, across).orderBy(along)


def box_mean(px: DataFrame, k: int, value: str = "v", out: str = "box", case: str = "case_id") -> DataFrame:
    """The mean over k x k around each pixel; beyond the edge are zeros that count. Rows first, then columns."""
    h = k // 2
    px = px.withColumn("__r", F.sum(value).over(_line(case, "x", "y").rowsBetween(-h, h)))
    return px.withColumn(out, F.sum("__r").over(_line(case, "y", "x").rowsBetween(-h, h)) / (k * k)).drop("__r")


def laplacian(px: DataFrame, value: str = "v", out: str = "laplacian", case: str = "case_id") -> DataFrame:
    """Four neighbours less four times the pixel; at the edge the neighbour on the other side counts twice."""
    total = -4 * F.col(value)
    for along, across in (("x", "y"), ("y", "x")):
        w = _line(case, along, across)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        total = total + F.coalesce(before, after) + F.coalesce(after, before)
    return px.withColumn(out, total)


def gradients(px: DataFrame, value: str = "v", case: str = "case_id") -> DataFrame:
    """dx and dy: the next pixel less this one; null at the far edge."""
    return px.withColumns({"dx": F.lead(value).over(_line(case, "x", "y")) - F.col(value), "dy": F.lead(value).over(_line(case, "y", "x")) - F.col(value)})


def profiles(px: DataFrame, value: str, case: str = "case_id") -> DataFrame:
    """row_mean and column_mean of each pixel's row and column."""
    return px.withColumns({"row_mean": F.avg(value).over(W.partitionBy(case, "y")), "column_mean": F.avg(value).over(W.partitionBy(case, "x"))})


def residual(observed: Column, generated: Column, uncertainty: Column) -> Column:
    return F.abs(observed - generated) / (1 + 4 * uncertainty)


def covering_mask(y: Column, x: Column, size: int) -> Column:
    """Which of four complementary masks covers a pixel."""
    q = size // 4
    return (F.floor(y / q) % 2) * 2 + F.floor(x / q) % 2


def noise_schedule(steps: int) -> list[float]:
    """Cumulative signal shares of a cosine schedule with steps cut at 0.999."""
    t = np.linspace(0, steps, steps + 1)
    f = np.cos((t / steps + 0.008) / 1.008 * np.pi / 2) ** 2
    beta = np.clip(1 - f[1:] / f[:-1], 1e-4, 0.999)
    return np.cumprod(1 - beta).tolist()


def _arrow_map(rows: DataFrame, key: str, vector: str, f, names: list[str], kind: str = "double") -> DataFrame:
    """f takes images (n, side, side) and returns one array for each name."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                side = int(round(flat.shape[1] ** 0.5))
                made = f(flat.reshape(-1, side, side))
                yield pa.record_batch([batch.column(0), *(pa.array(list(m) if m.ndim > 1 else m) for m in made)], [key, *names])

    schema = ", ".join([f"{key} {dict(rows.dtypes)[key]}", *(f"{n} {kind}" for n in names)])
    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


# The bounds of the radial bands, in cycles per pixel.
BANDS = ((0.0, 0.18), (0.18, 0.36), (0.36, 0.72))


def spectral_bands(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """log1p of 100 times the mean energy in three radial bands of each image's spectrum."""

    def f(x: np.ndarray):
        n = x.shape[1]
        power = np.abs(np.fft.fft2(x)) ** 2 / (n * n)
        radius = np.hypot(*np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n), indexing="ij"))
        return [np.log1p(100 * power[:, (radius > lo) & (radius <= hi)].mean(1)) for lo, hi in BANDS]

    return _arrow_map(rows, key, vector, f, ["band_low", "band_middle", "band_high"])


def _power(x: np.ndarray) -> np.ndarray:
    """(n, 2, bins): orthonormal power of the windowed row and column profiles without their means, the constant's bin first."""
    n = x.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)  # periodic
    both = np.stack((x.mean(2), x.mean(1)), 1)
    return np.abs(np.fft.rfft((both - both.mean(2, keepdims=True)) * hann, norm="ortho")) ** 2


def _directional(x: np.ndarray) -> np.ndarray:
    return np.log1p(100 * _power(x)[..., 1:])


def _peaks(x: np.ndarray, skip: int = 3) -> np.ndarray:
    """How far each bin rises above its eight neighbours (zeros beyond the ends); of all bins the first `skip` are left out."""
    power = _power(x)
    padded = np.pad(power, ((0, 0), (0, 0), (4, 4)))
    near = (sum(padded[..., i : i + power.shape[-1]] for i in range(9)) - power) / 8
    return np.log1p(power / (near + 1e-4))[..., skip:]


def directional_power(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Spectra of the row and the column profile, without their means, windowed: log1p of 100 times the power."""
    return _arrow_map(rows, key, vector, lambda x: [_directional(x)[:, 0], _directional(x)[:, 1]], ["row_power", "column_power"], "array<double>")


def frequency_peaks(rows: DataFrame, key: str, vector: str, skip: int = 3) -> DataFrame:
    """The highest of each profile's frequencies above its eight neighbours; the first `skip` are left out."""
    return _arrow_map(rows, key, vector, lambda x: list(_peaks(x, skip).max(2).T), ["row_peak", "column_peak"])
