"""Connected components by least labels with pointer jumping, over DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Columns a, b of undirected links -> node, label: the least node that links reach. Nodes without links are absent.

    Each round takes the least label of a node and its neighbours, then that label's own label, so that long chains
    halve. Each round is written out, which cuts the lineage. Null ends and self-links are left out.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.write(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("seen"))
        jump = labels.select(F.col("node").alias("seen"), F.col("label").alias("far"))
        step = step.join(jump, "seen", "left").select("node", F.least("seen", F.coalesce("far", "seen")).alias("label"), (F.least("seen", F.coalesce("far", "seen")) < F.col("label")).alias("moved"))
        k += 1
        step = scratch.write(step, f"{name}-{k}")
        moved = step.where("moved").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
        scratch.drop(f"{name}-{k - 1}")
