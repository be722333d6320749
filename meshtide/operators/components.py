"""Connected components by contraction: hook every node to its best neighbour, contract, repeat.

Node priorities are hashed, so a long chain of ordered ids still contracts geometrically.  Each
round's mapping is checkpointed; edges shrink every round, and no neighbour list is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.session import durable, release


def _ranked_id(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), undirected edges (a, b) -> (id, root); every component shares one root."""
    edges = durable(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps, left = [], edges.count()
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_ranked_id("b")).alias("m"))
        hook = best.select("a", F.least(F.col("m"), _ranked_id("a"))["id"].alias("p"))
        # parents strictly decrease in priority, so following them twice stays inside the tree
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("a", F.col("pp").alias("p"))
        hook = durable(hook)
        maps.append(hook)
        ends = edges.join(hook, "a").select("b", F.col("p").alias("pa"))
        ends = ends.join(hook.withColumnRenamed("a", "b"), "b").select("pa", F.col("p").alias("pb"))
        old, edges = edges, durable(ends.filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        release(old)
        # every end of an edge hooks to its least neighbour or itself, so some edge contracts in every round
        before, left = left, edges.count()
        if left >= before:
            raise RuntimeError("a round of contraction made no progress")
    label = None
    for m in reversed(maps):
        if label is None:
            label = m.select("a", F.col("p").alias("root"))
        else:
            up = label.select(F.col("a").alias("p"), "root")
            label = m.join(up, "p", "left").select("a", F.coalesce("root", "p").alias("root"))
    if label is None:
        return nodes.select("id", F.col("id").alias("root"))
    if len(maps) > 1:
        label = durable(label)
        release(*maps)
    found = nodes.join(label.withColumnRenamed("a", "id"), "id", "left")
    return found.select("id", F.coalesce("root", "id").alias("root"))
