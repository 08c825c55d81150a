"""Classes of near copies: what verified pairs of groups connect, told for each member of the groups.

Rows grow with the documents, never with the pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges, read off its table without a shuffle."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("decimal(38, 0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for each identifier in pairs (a, b): the least one that pairs connect it with.

    Large-star and small-star rounds in turn until nothing changes; each is a written table, and every round at least halves
    long chains.
    """
    edges = table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    known = _print(edges)
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        edges = table(small.where("u <> v").distinct())
        now = _print(edges)
        if now == known:
            roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
            return table(roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))
        known = now


def describe(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, root, class_id, links) of each group, as a written table.

    pairs (ga, gb), each two groups once, and members (gid, id), each member once, are written tables. root names what pairs
    connect, class_id is the least member of that, and links counts the other members of a member's own group and those of
    the groups that are paired with it.
    """
    sizes = table(members.groupBy("gid").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("ga").alias("gid"), F.col("gb").alias("other")), F.struct(F.col("gb").alias("gid"), F.col("ga").alias("other")))).alias("e")).select("e.*")
    linked = ends.join(sizes.select(F.col("gid").alias("other"), "n"), "other").groupBy("gid").agg(F.sum("n").alias("linked"))
    roots = components(pairs.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).withColumnRenamed("id", "gid")
    names = roots.join(sizes, "gid").groupBy("root").agg(F.min("least").alias("class_id"))
    connected = roots.join(names, "root").join(linked, "gid").select("gid", "root", "class_id", "linked")
    told = sizes.join(connected, "gid", "left")
    return table(told.select("gid", F.coalesce("root", "gid").alias("root"), F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links")))
