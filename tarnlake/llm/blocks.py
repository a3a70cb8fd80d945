"""Links of a relation between the members of groups of any size, no group gathered in one task.

A group beyond a bound is cut into blocks by hash, and each block is searched for
links by itself.  Links already found make clusters; one member of each cluster
stands for it in the next round, which is cut again, until clusters no longer
merge.  A group of which one cluster is left is done: further links in it change
nothing.  Of the others, blocks made of one large cluster, and blocks of what is
in small ones, are searched pair by pair, but for two blocks of one cluster.  So
every two members are either connected or compared; what a task holds is two
blocks at most (a single member beyond the bound is a block of its own size).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected


def _blocked(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """Number of blocks and block of every row; only the groups that need more than one are joined back."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.sum("weight") / limit).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(sizes, list(by), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")))


def linked(rows: DataFrame, tmp: Scratch, name: str, limit: int, load: Callable[[DataFrame], DataFrame], find) -> DataFrame:
    """src, dst: links whose components are those of the whole relation within each group.

    ``rows``: grp, fp, weight (and what ``load`` needs).  ``load`` turns rows (grp,
    block, fp, ...) into what ``find`` reads in order of grp and block: an Arrow
    function that yields links within each run of one grp and block.
    """

    def search(part: DataFrame, step: str) -> DataFrame:
        ready = load(part).repartition("grp", "block").sortWithinPartitions("grp", "block")
        return tmp.write(ready.mapInArrow(find, "src long, dst long"), f"{name}-{step}")

    every = _blocked(rows, limit, "grp")
    found = [search(every, "first")]
    hot = tmp.write(every.where("blocks > 1").drop("blocks", "block"), f"{name}-hot")
    if hot.isEmpty():
        return found[0]
    before = None
    for level in range(64):  # each round but the last halves the members that stand for clusters
        roots = connected(reduce(DataFrame.unionByName, found), tmp, f"{name}-roots-{level}").select(F.col("node").alias("fp"), "root")
        named = tmp.write(hot.join(roots, "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root"), f"{name}-named-{level}")
        several = named.groupBy("grp").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z").select("grp")
        named = tmp.write(named.join(several, "grp", "left_semi"), f"{name}-open-{level}")
        first = named.groupBy("grp", "label").agg(F.min("fp").alias("fp"))
        n = first.count()
        if not n:
            return reduce(DataFrame.unionByName, found)
        if before is not None and 2 * n > before:
            break
        before = n
        heads = named.join(first.select("grp", "fp"), ["grp", "fp"], "left_semi").drop("label")
        found.append(search(_blocked(heads, limit, "grp"), f"heads-{level}"))
    own = named.groupBy("grp", "label").agg(F.sum("weight").alias("w")).where(F.col("w") > limit / 2).select("grp", "label", F.lit(True).alias("large"))
    pooled = named.join(own, ["grp", "label"], "left").withColumn("pool", F.when(F.col("large"), F.col("label").cast("string")).otherwise("rest")).drop("large", "label")
    pooled = tmp.write(_blocked(pooled, limit, "grp", "pool").withColumnRenamed("block", "part").drop("blocks"), f"{name}-pooled")
    parts = tmp.write(pooled.select("grp", "pool", "part").distinct(), f"{name}-parts")
    a, b = parts.alias("a"), parts.alias("b")
    place = lambda x: F.struct(f"{x}.pool", f"{x}.part")
    pairs = a.join(b, F.col("a.grp") == F.col("b.grp")).where((place("a") <= place("b")) & ((F.col("a.pool") != F.col("b.pool")) | (F.col("a.pool") == "rest")))
    pairs = tmp.write(pairs.select("a.grp", F.monotonically_increasing_id().alias("block"), F.array_distinct(F.array(place("a"), place("b"))).alias("sides")), f"{name}-pair-list")
    sides = pairs.select("grp", "block", F.explode("sides").alias("s")).select("grp", "block", "s.pool", "s.part")
    return reduce(DataFrame.unionByName, [*found, search(pooled.join(sides, ["grp", "pool", "part"]).drop("pool", "part"), "pairs")])
