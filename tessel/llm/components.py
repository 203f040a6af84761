"""Connected components by contraction, with no node or edge set ever held in one place.

In each round every node points to the neighbour (or itself) whose salted hash is least, and edges are carried over to the
nodes pointed to. The hash order is new in each round, so a chain loses a constant share of its nodes on average. Rounds
end when no edge is left; the pointers are then followed back. Edges that all meet in one node are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.sources.store import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node long, root long): nodes that edges touch, and one root for each component."""
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while edges.take(1):
        salt = F.lit(len(maps))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("v"))
        near = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = F.when(F.col("m") < order("a"), F.col("m.v")).otherwise(F.col("a"))
        step = stash(near.select(F.col("a").alias("node"), to.alias("root")), "step")
        maps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, edges = edges, stash(moved, "edges")
        discard(old)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = step.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = stash(out, "components")
    discard(edges, *maps)
    return out
