"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps, each an aggregation and a join on the node, so that a node
    with many neighbours is pre-aggregated and its join can be split. The number of rounds grows with the
    logarithm of the longest chain; each round's table replaces the one before.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs (u, v): each node's least neighbour, itself included
        both = pairs.union(pairs.select("v", "u")) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v")

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = Scratch(links.sparkSession)
    now = before.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was, seen = None, mark(now)
    while seen[0] and seen != was:
        after = Scratch(links.sparkSession)
        now = after.keep(star(star(now, True), False).distinct())
        before.__exit__()
        before, was, seen = after, seen, mark(now)
    found = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return found.union(now.select("v", "v").distinct()).distinct()
