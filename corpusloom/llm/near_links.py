"""Links between sets: confirmation on the full sets, and what stars around pivots leave over.

A star is the pairs (a, b) of a pivot a with the members b of its buckets. ``by_differences`` finds, without
pairing all members, which members of a star may link with each other. Write D(x) for the shingles that exactly
one of x and the pivot has. Then x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, and a link at the
threshold t (percent) allows (100 - t) / (100 + t) of |x| + |y| at most, so a link is the same as

    2 (100 + t) |D(x) & D(y)|  >=  near(x) + near(y),   near(x) = (100 + t) |D(x)| - (100 - t) |x|,

and needs |D(x) & D(y)| >= |D(x)| - (100 - t) / (100 + t) (|x| + |y|) as well. That is a join of sets on a minimum
overlap, for which prefixes are exact: with the differences of a star in one order (rare ones first), the first
common one lies in the first ``size - overlap + 1`` of either, and enough others must follow it in both.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches
from corpusloom.session import Scratch

#: Bits of the filter that spares most texts the way to Python; its table has a row for each 64 of them at most.
FILTER_BITS = 1 << 24


def perhaps_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``id`` may be among those of ``keys``: all that are, and few others.

    The filter is a bitmap over hashed ids, broadcast at ``FILTER_BITS`` / 64 rows at most however many keys there
    are; the more there are, the less it spares.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    word, bit = F.floor(place / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))")
    words = keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    return rows.join(F.broadcast(words), word == F.col("__word")).where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


def with_set(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """``pairs`` with the shingles of ``key``. A pivot's many rows are a skewed join, which adaptive execution splits."""
    return pairs.join(sets.select(F.col("node").alias(key), F.col("shingles").alias(f"set_{key}")), key)


def confirm(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int, likely: Callable[[pa.RecordBatch, int], pa.RecordBatch], scratch: Scratch) -> DataFrame:
    """Of ``pairs`` (a, b) those with 100 * intersection >= threshold * union, decided on the full sets.

    ``likely`` drops pairs that their registers show to be hopeless; ``a`` may be hot (a pivot).
    """
    kind = pairs.schema["a"].dataType.simpleString()
    side = sketches.select("node", F.struct("n", "regs").alias("shingles"))
    both = with_set(with_set(pairs, side, "b"), side, "a")
    both = both.select("a", "b", F.col("set_a.n").alias("n_a"), F.col("set_b.n").alias("n_b"), F.col("set_a.regs").alias("regs_a"), F.col("set_b.regs").alias("regs_b"))
    left = scratch.keep(map_batches(both, lambda x: likely(x, threshold), f"a {kind}, b {kind}, n_a long, n_b long", rows=4000))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return scratch.keep(with_set(with_set(left, sets, "b"), sets, "a").where(100 * common >= threshold * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"))


def placed(rows: DataFrame, reached: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the component of ``key`` so far, which is itself where nothing is linked to it."""
    found = reached.select(F.col("id").alias(key), F.col("component").alias("__c"))
    return rows.join(found, key, "left").withColumn(name, F.coalesce("__c", key)).drop("__c")


def by_differences(stars: DataFrame, reached: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members of one star, in two components so far, that link or nearly do (see above).

    At least one of two such members ("open") is outside its pivot's component. Differences that one component
    alone has cannot be common to a pair and take no part.
    """
    at = placed(placed(stars, reached, "a", "of_a"), reached, "b", "of_b").withColumn("open", F.col("of_a") != F.col("of_b"))
    at = scratch.keep(at)
    mixed = at.groupBy("a").agg(F.max("open").alias("any"), F.min("of_b").alias("low"), F.max("of_b").alias("high")).where("any and low <> high").select("a")
    both = with_set(with_set(at.join(mixed, "a", "left_semi").select("a", "b", "of_b", "open"), sets, "b"), sets, "a")
    diff = F.concat(F.array_except("set_b", "set_a"), F.array_except("set_a", "set_b"))
    # stars, members of stars and components go by 64-bit numbers from here on
    rows = both.select(F.xxhash64("a").alias("star"), F.xxhash64("a", "b").alias("member"), "b", F.xxhash64("of_b").alias("home"), "open", F.size("set_b").cast("long").alias("n"), diff.alias("diff"))
    up, down = 100 + threshold, 100 - threshold
    rows = rows.withColumn("near", up * F.size("diff") - down * F.col("n")).withColumn("far", F.col("near") + 2 * down * F.col("n"))
    rows = scratch.keep(rows)
    limits = rows.groupBy("star").agg(F.min(F.when(F.col("open"), F.col("near"))).alias("least_open"), F.min("near").alias("least"), F.max("n").alias("largest"))
    # the least overlap with any possible partner, by either bound
    partner = F.least(F.col("largest").cast("double"), 100 * F.col("n") / threshold)
    other = F.when(F.col("open"), F.col("least")).otherwise(F.col("least_open"))
    need = F.greatest(F.lit(1), F.ceil((F.col("near") + other) / (2 * up)), F.ceil(F.size("diff") - down * (F.col("n") + partner) / up)).cast("int")
    rows = rows.join(limits, "star").where("far >= least_open").withColumn("need", need).where("size(diff) >= need")
    each = rows.select("star", "member", "home", F.explode("diff").alias("e")).select(F.xxhash64("star", "e").alias("key"), "member", "home")
    shared = each.groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count("*").alias("held")).where("low <> high").select("key", "held")
    lists = each.join(shared, "key").groupBy("member").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("common"))
    rows = scratch.keep(rows.drop("diff", "star", "least_open", "least", "largest").join(lists, "member").where("size(common) >= need"))
    prefix = rows.select("b", "home", "open", "n", "near", "far", F.size("common").alias("size"), F.posexplode(F.slice("common", F.lit(1), F.expr("size(common) - need + 1"))).alias("place", "c"))
    prefix = prefix.select("b", "home", "open", "n", "near", "far", F.col("c.key").alias("key"), (F.col("size") - F.col("place")).alias("rest"))
    x, y = prefix.where("open").alias("x"), prefix.alias("y")
    sizes = 100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    overlap = 2 * up * F.least("x.rest", "y.rest") >= F.col("x.near") + F.col("y.near")
    reach = (F.col("x.near") <= F.col("y.far")) & (F.col("y.near") <= F.col("x.far"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.home") != F.col("y.home")) & sizes & overlap & reach)
    return scratch.keep(met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct())
