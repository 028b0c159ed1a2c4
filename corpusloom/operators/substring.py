"""Substring search over blocks of pages, pruned by their trigrams.

A block is 100 ordinals of a version. The index knows which blocks hold which three characters in a row (of title, URL
and content, in lower case); a phrase can only occur in blocks that hold all of its own. Their pages are then searched for the
phrase itself, so results are those of reading everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import store
from corpusloom.operators.parts import of_keys
from corpusloom.operators.store import KEYS
from corpusloom.session import ship_package

#: Ordinals in a block.
BLOCK = 100
#: Characters of a gram; a shorter phrase has none and is searched for everywhere.
LENGTH = 3
#: Candidate blocks that the first read is about; only where they hold too few hits the others are read too.
FIRST_BLOCKS = 100


def block_of(ordinal: Column) -> Column:
    return F.floor(ordinal / BLOCK).cast("long")


def grams(pages: DataFrame) -> DataFrame:
    """``gram, technology, version, block``, each once. Repeats of a block's pages that stand near each other go before the shuffle."""
    ship_package(pages.sparkSession)
    rows = pages.select(*KEYS, block_of(F.col("ordinal")).alias("block"), store.searched().alias("text"))
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*KEYS, "block"))
    return rows.mapInArrow(_cut, f"gram string, {keys}").distinct()


#: Pages whose grams leave a worker together.
PAGES_A_SLICE = 1000


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each block of a slice of pages."""
    by = [*KEYS, "block"]
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES_A_SLICE):
            batch = whole.slice(start, PAGES_A_SLICE)
            held: dict[tuple, set[str]] = {}
            first: dict[tuple, int] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True)):
                text = batch.column("text")[i].as_py()
                first.setdefault(key, i)
                held.setdefault(key, set()).update(map("".join, zip(*[text[k:] for k in range(LENGTH)])))
            found = pa.array([g for of_block in held.values() for g in of_block], pa.string())
            rows = pa.array([first[key] for key, of_block in held.items() for _ in of_block], pa.int64())
            yield pa.RecordBatch.from_arrays([found, *[batch.column(c).take(rows) for c in by]], names=["gram", *by])


def grams_of(phrase: str) -> list[str]:
    return list(dict.fromkeys(phrase[i : i + LENGTH] for i in range(len(phrase) - LENGTH + 1)))


def candidates(index: DataFrame, phrase: str) -> DataFrame:
    """(technology, version, block) of the blocks that hold all grams of a phrase of at least ``LENGTH`` characters."""
    asked = grams_of(phrase.lower())
    return of_keys(index, asked, "gram").groupBy(*KEYS, "block").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).drop("n")


def _within(blocks: list) -> Column:
    """Pages of few blocks, as ranges that a scan can prune by."""
    out = F.lit(False)
    for b in blocks:
        same = F.col("technology").eqNullSafe(b["technology"]) & F.col("version").eqNullSafe(b["version"])
        if b["block"] is None:
            out = out | (same & F.col("ordinal").isNull())
        else:
            out = out | (same & (F.col("ordinal") >= b["block"] * BLOCK) & (F.col("ordinal") < (b["block"] + 1) * BLOCK))
    return out


def search(pages: DataFrame, index: DataFrame, phrase: str, limit: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """The rows of ``store.substring_search``, read from candidate blocks alone; ``index`` are the grams of ``pages``.

    The first candidates in store order are searched first. They suffice unless they hold fewer hits than asked for and
    more candidates follow; then all candidates are joined with the pages.
    """
    if len(phrase.lower()) < LENGTH:
        return store.substring_search(pages, phrase, limit)
    found = candidates(index, phrase)
    head = found.orderBy(*KEYS, "block").limit(first_blocks + 1).collect()
    near = store.substring_search(pages.where(_within(head[:first_blocks])), phrase, limit)
    if len(head) <= first_blocks or near.count() >= max(1, min(100, limit)):
        return near
    same = block_of(F.col("l.ordinal")).eqNullSafe(F.col("r.block"))
    for key in KEYS:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return store.substring_search(pages.alias("l").join(found.alias("r"), same, "left_semi"), phrase, limit)


def pruning(pages: DataFrame, index: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, blocks, candidates): what of the blocks each phrase has to be looked for in; ``pages`` need no contents."""
    blocks = pages.select(*KEYS, block_of(F.col("ordinal")).alias("block")).distinct()
    rows = blocks.select(F.explode(F.array(*[F.lit(p) for p in phrases])).alias("phrase"), F.lit(False).alias("held"))
    for phrase in phrases:
        rows = rows.unionByName(candidates(index, phrase).select(F.lit(phrase).alias("phrase"), F.lit(True).alias("held")))
    return rows.groupBy("phrase").agg(F.count_if(~F.col("held")).alias("blocks"), F.count_if("held").alias("candidates"))
