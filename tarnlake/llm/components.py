"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v) with u > v, without gathering a neighbourhood.

    Large star: every larger neighbour of u moves to the least of u and its
    neighbours.  Small star: u and its smaller neighbours move to the least one.
    The least neighbour is a pre-aggregated minimum that is joined back, so a hub
    with a third of all links is split by the skew join instead of one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected(edges: DataFrame, tmp: Scratch, name: str = "cc") -> DataFrame:
    """node, root (the least node reachable) for every node of ``edges`` (src, dst).

    Stops when a round changes no row.  Edges within a component only shrink, so
    the number of rounds grows with the logarithm of the longest chain.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = tmp.write(e, f"{name}-0")
    sign = None
    for k in range(1, 200):
        large = tmp.write(_step(e, True), f"{name}-{k}l")
        nxt = tmp.write(_step(large, False), f"{name}-{k}")
        tmp.drop(f"{name}-{k}l", f"{name}-{k - 1}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        e = nxt
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle in 200 rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
