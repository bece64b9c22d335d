"""Connected components of an edge table by label propagation with shortcuts.

Each round every node takes the smallest label among its own and its
neighbours', then the label of its label.  A round is three equi-joins whose
sides are plain tables, so the edges of a node with very many neighbours are
split between tasks; sums per node are taken before the shuffle.  Labels of
each round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``edges`` (a long, b long)."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.filter("a <> b").select(F.explode(ways).alias("way")).select("way.a", "way.b")
    links = scratch.table(both.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), f"{name}-links")
    labels = scratch.table(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), f"{name}-labels-0")
    turn = 0
    while True:
        turn += 1
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("next"))
        own = scratch.table(own, f"{name}-near-{turn}")
        target = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = own.join(target, own["next"] == target["via"], "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("before"))
        fresh = scratch.table(jumped, f"{name}-labels-{turn}")
        changed = fresh.filter(F.col("label") < F.col("before")).limit(1).count()
        scratch.drop(f"{name}-labels-{turn - 1}", f"{name}-near-{turn}")
        labels = fresh.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-links")
            return labels.withColumnRenamed("label", "component")
