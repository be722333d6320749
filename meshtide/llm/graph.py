"""Connected components by repeated contraction; every table stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of one orderable type); nodes are connected exactly if their roots agree.

    Each round maps a node to the least of itself and its neighbours in a fresh random order and contracts the
    graph, until no edge is left; the maps are then composed from the last to the first. The order's minimum
    is a map-side combined aggregate, so a node with very many neighbours costs one row per task.
    """
    maps: list[DataFrame] = []
    left = scratch.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), few=True)
    while not left.isEmpty():
        rank = F.struct(F.xxhash64("to", F.lit(len(maps))).alias("p"), F.col("to"))
        both = left.select(F.col("a").alias("node"), F.explode(F.array("a", "b")).alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.explode(F.array("a", "b")).alias("to")))
        image = scratch.cut(both.groupBy("node").agg(F.min(rank)["to"].alias("image")), few=True)
        maps.append(image)
        at_a = image.select(F.col("node").alias("a"), F.col("image").alias("ia"))
        at_b = image.select(F.col("node").alias("b"), F.col("image").alias("ib"))
        moved = left.join(at_a, "a").join(at_b, "b").where("ia <> ib")
        after = scratch.cut(moved.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct(), few=True)
        scratch.drop(left)
        left = after
    scratch.drop(left)
    if not maps:
        return edges.where("false").select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = maps[-1].select("node", F.col("image").alias("root"))
    for image in reversed(maps[:-1]):
        last = root.select(F.col("node").alias("image"), F.col("root").alias("far"))
        root = scratch.cut(image.join(last, "image", "left").select("node", F.coalesce("far", "image").alias("root")), few=True)
    return root
