"""Robust scales with their floors, clipped scores, finite scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes the median absolute deviation a standard deviation for normal data, and the distance of the 10th and 90th percentile one.
MAD, SPREAD = 1.4826, 2.563


def scale(mad: Column, policy: str, spread: Column | None = None) -> Column:
    """A scale from a median absolute deviation that never is zero.

    plus: 1e-6 is added; most: 1e-6 at least; clamp: 0.01 at least; spread: where the deviation is at most 1e-6, the distance of
    the 10th and 90th percentile stands in, and 1e-6 at least.
    """
    wide = mad * F.lit(MAD)
    match policy:
        case "plus":
            return wide + F.lit(1e-6)
        case "most":
            return F.greatest(wide, F.lit(1e-6))
        case "clamp":
            return F.greatest(wide, F.lit(0.01))
        case "spread":
            return F.greatest(F.when(mad <= 1e-6, spread / F.lit(SPREAD)).otherwise(wide), F.lit(1e-6))
    raise ValueError(f"unknown policy {policy}")


def clipped(z: Column) -> Column:
    """The positive part of a robust score, at most 100."""
    return F.least(F.greatest(z, F.lit(0.0)), F.lit(100.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))
