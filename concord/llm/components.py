"""Connected components of a distributed edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with ``m``, the least of u and its v. The minimum is pre-aggregated; the join back has one row a node on one side, so adaptive execution splits a hub's edges."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    moved = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them; edges run from the larger end."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return _with_least(down).select(F.inline(ends)).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, root)``: root is the least node that can be reached.

    Nodes without edges to another node are not in the result. Null ends and loops are ignored.
    Each half of a round is written to the shared folder, so a lost executor repeats one round at most, and no plan holds more than
    two reads of the edges: the driver keeps every plan and each of its changes.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        before, large = edges, materialise(_large_star(edges), "edges")
        edges = materialise(_small_star(large), "edges")
        release(before, large)
        n, digest = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, digest) == seen:
            break
        seen = (n, digest)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
