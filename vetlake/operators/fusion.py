"""Robust calibration on normal rows, fused scores, thresholds, flags, variants and explanations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robust import clipped, finite, scale
from .selection import quantiles

# The branches and the weights of the named variants.
BRANCHES = ("diffusion", "semantic", "spectral", "latent")
WEIGHTS = {
    "V1_diffusion": (1.0, 0.0, 0.0, 0.0),
    "V2_diffusion_semantic": (0.4 / 0.65, 0.25 / 0.65, 0.0, 0.0),
    "V3_full": (0.4, 0.25, 0.2, 0.15),
    "without_semantic": (0.4 / 0.75, 0.0, 0.2 / 0.75, 0.15 / 0.75),
    "without_spectral": (0.4 / 0.8, 0.25 / 0.8, 0.0, 0.15 / 0.8),
    "without_latent": (0.4 / 0.85, 0.25 / 0.85, 0.2 / 0.85, 0.0),
    "equal": (0.25, 0.25, 0.25, 0.25),
}


def fit(normal: DataFrame, branches=BRANCHES, policy: str = "plus") -> DataFrame:
    """One row: median_<branch> and scale_<branch> of the normal rows, by two distributed selections, each made once."""
    wanted = {f"median_{b}": (b, 0.5) for b in branches}
    if policy == "spread":
        wanted |= {f"{end}_{b}": (b, q) for b in branches for end, q in (("low", 0.1), ("high", 0.9))}
    first = quantiles(normal, [], wanted)
    gone = normal.crossJoin(F.broadcast(first)).select(*(F.abs(F.col(b) - F.col(f"median_{b}")).alias(b) for b in branches))  # one row
    both = first.crossJoin(quantiles(gone, [], {f"mad_{b}": (b, 0.5) for b in branches}))
    spread = lambda b: F.col(f"high_{b}") - F.col(f"low_{b}") if policy == "spread" else None
    return both.select(*(F.col(f"median_{b}") for b in branches), *(scale(F.col(f"mad_{b}"), policy, spread(b)).alias(f"scale_{b}") for b in branches))


def z(branch: str) -> Column:
    return (F.col(branch) - F.col(f"median_{branch}")) / F.col(f"scale_{branch}")


def with_z(rows: DataFrame, state: DataFrame, branches=BRANCHES, clip: bool = False) -> DataFrame:
    """rows with z_<branch>, by the one-row state."""
    out = rows.crossJoin(F.broadcast(state))  # one row
    out = out.withColumns({f"z_{b}": clipped(z(b)) if clip else z(b) for b in branches})
    return out.drop(*state.columns)


def weighted(weights, branches=BRANCHES) -> Column:
    """The weighted sum of clipped z."""
    return sum((F.lit(w) * F.col(f"z_{b}") for w, b in zip(weights, branches, strict=True) if w), F.lit(0.0))


def by_variant(rows: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """One row for each row and variant, with `variant` and its `score`, from a single scan."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), c.cast("double").alias("score")) for name, c in variants.items())))
    return rows.withColumn("__v", each).select("*", "__v.variant", "__v.score").drop("__v")


def weight_variants(branches=BRANCHES) -> dict[str, Column]:
    return {name: weighted(w, branches) for name, w in WEIGHTS.items()}


def subset_variants(branches, subsets: list[tuple[str, ...]] | None = None) -> dict[str, Column]:
    """The mean and the greatest of the z of each subset; of a single branch only the mean."""
    if subsets is None:
        subsets = [s for n in range(1, len(branches) + 1) for s in combinations(branches, n)]
    out = {}
    for s in subsets:
        own = [F.col(f"z_{b}") for b in s]
        out["+".join(s) + "_mean"] = sum(own[1:], own[0]) / len(own)
        if len(own) > 1:
            out["+".join(s) + "_max"] = F.greatest(*own)
    return out


def thresholds(normal: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The exact quantile of normal scores of each key."""
    return quantiles(normal, keys, {"threshold": ("score", q)})


def flag(rows: DataFrame, limit: DataFrame, keys: list[str]) -> DataFrame:
    """rows with threshold and flagged: strictly above it. A score that is not finite is never flagged."""
    out = rows.join(limit, keys) if keys else rows.crossJoin(F.broadcast(limit))  # one row without keys
    return out.withColumn("flagged", finite(F.col("score")) & (F.col("score") > F.col("threshold")))


def explain(branches=BRANCHES, weights=WEIGHTS["V3_full"], top: int = 2) -> Column:
    """The branches that contribute most, largest first, as a text."""
    parts = F.array(*(F.struct((F.lit(w) * F.col(f"z_{b}")).alias("c"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, (b, w) in enumerate(zip(branches, weights, strict=True))))
    return F.array_join(F.transform(F.slice(F.sort_array(parts, False), 1, top), lambda x: x.getField("b")), " and ")
