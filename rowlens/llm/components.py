"""Connected components of an edge table by repeated contraction, all in joins and groupings.

Each round every vertex takes its smallest neighbour (or itself) as parent,
parents are followed twice, edges are moved to the parents and loops dropped.
Every vertex that is no local minimum merges, so the edges shrink at least
geometrically in vertices; star-like link tables end after one or two rounds.
Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import drop_stage, stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (a, b); the component is its smallest vertex."""
    now = stage_table(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels: DataFrame | None = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            higher = stage_table(parent.join(up, "p").select("a", F.col("q").alias("p")), "parents")
            drop_stage(parent)
            parent = higher
        if labels is None:
            merged = stage_table(parent.select(F.col("a").alias("node"), F.col("p").alias("component")), "labels")
        else:
            up = parent.select(F.col("a").alias("component"), "p")
            moved = labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            merged = stage_table(moved, "labels")
            drop_stage(labels)
        labels = merged
        left = parent.select("a", F.col("p").alias("pa"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = now.join(left, "a").join(right, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        contracted = stage_table(moved.distinct(), "edges")
        drop_stage(now)
        drop_stage(parent)
        now = contracted
    if labels is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
