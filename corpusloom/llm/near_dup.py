"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles (64-bit hashes). One pass makes its sketch: the hashes are
dealt over buckets, and each bucket stores the leading-zero count of its smallest hash and the mantissa bits
that follow (6 + 10 bits); empty buckets borrow from filled ones in an order fixed by their number. Documents
with equal sets form one class. Bands of registers propose pairs of classes, the collision-corrected estimate
of the Jaccard similarity drops hopeless ones, and every other pair is confirmed on the full shingle sets.

Within a band bucket members are compared with a pivot only (who meets most others), so that a bucket of thousands of
copies gives thousands of pairs and not millions. Members outside the pivot's component can link only through what
sets them apart from the pivot; they are joined on those few shingles, and no link between components is lost
(``near_links.by_differences`` has the argument). Connected components are found by alternating stars.

At a similarity of 0.75 a pair shares no band with probability (1 - 0.75**4)**40, below 3e-7.

Defined cases: a null or empty text has no shingles and links with nothing; fewer words than a shingle has are
one shingle; equal sets, and rows that repeat, are one class; rows that share an id and not a text are linked by
their texts alone; a null id is a component of its own (null, kept); an empty table gives an empty result; columns
other than the named ones are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import CHUNK_BYTES, free_name, map_batches, materialise, mix64, row_chunks, sums_by_row, text_bytes, with_names
from corpusloom.llm.graph import components
from corpusloom.llm.near_links import by_differences, confirm, perhaps_in, placed
from corpusloom.session import Scratch

SHINGLE_WORDS, THRESHOLD = 5, 75
BANDS, BAND_ROWS = 40, 4
BUCKETS = BANDS * BAND_ROWS
ZERO_BITS, MANTISSA_BITS = 6, 10
#: How many standard deviations below the threshold an estimate may lie before its pair is dropped.
DEVIATIONS = 6.5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


@lru_cache(maxsize=1)
def _held_powers() -> tuple[np.ndarray, np.ndarray]:
    """One table per worker, for chunks of usual size."""
    return _powers(2 * CHUNK_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


def word_ends(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word of the rows ends (exclusive)."""
    blank = BLANK[flat]
    stop = ~blank
    stop[:-1] &= blank[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = ~blank[last]
    return np.flatnonzero(stop) + 1


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the rows, and how many words each row has."""
    blank = BLANK[flat]
    start = ~blank
    start[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edges] = ~blank[edges]
    at = np.flatnonzero(start)
    end = word_ends(flat, offsets)
    counts = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
    if not len(at):
        return np.zeros(0, np.uint64), counts
    # a polynomial hash from sums of powers: each word's sum, shifted to begin at power 0
    power, inverse = _held_powers() if len(flat) < 2 * CHUNK_BYTES else _powers(len(flat) + 1)
    byte = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))[LOWER[flat]]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * power[: len(flat)])])
    return mix64((total[end] - total[at]) * inverse[at] ^ (end - at).astype(np.uint64)), counts


def shingle_sets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, end to end, and how many each row has."""
    words, counts = word_hashes(flat, offsets)
    n = len(words)
    if not n:
        return words, counts
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    left = ends[row] - np.arange(n)  # words from here to the row's end
    begins = np.arange(n) == (ends - counts)[row]
    short = np.minimum(counts, SHINGLE_WORDS)[row]
    keep = (left >= SHINGLE_WORDS) | (begins & (counts[row] < SHINGLE_WORDS))
    padded = np.concatenate([words, np.zeros(SHINGLE_WORDS, np.uint64)])
    value = short.astype(np.uint64)
    for k in range(SHINGLE_WORDS):
        part = mix64(padded[k : k + n] + ODD[k]) * ODD[k]
        value = value + (part if k == 0 else np.where(k < short, part, np.uint64(0)))
    value, row = mix64(value)[keep], row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(counts))


@lru_cache(maxsize=1)
def _borrow_order() -> np.ndarray:
    """For each bucket, the order in which it looks for a filled one (itself first)."""
    out = np.empty((BUCKETS, BUCKETS), np.int64)
    for b in range(BUCKETS):
        rest = np.delete(np.arange(BUCKETS), b)
        keys = mix64(np.uint64(b * BUCKETS) + rest.astype(np.uint64))
        out[b] = np.concatenate([[b], rest[np.argsort(keys, kind="stable")]])
    return out


def registers(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of each row's set (rows x buckets, 16 bits); of an empty set all ones."""
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    bucket = (values % np.uint64(BUCKETS)).astype(np.int64)
    rank = mix64(values + np.uint64(0x51ED270B))
    least = np.full(rows * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row * BUCKETS + bucket, rank)
    least = least.reshape(rows, BUCKETS)
    filled = least != np.iinfo(np.uint64).max
    for r in np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1)):
        order = _borrow_order()
        empty = np.flatnonzero(~filled[r])
        least[r, empty] = least[r, order[empty, filled[r][order[empty]].argmax(axis=1)]]
    # leading zeros, and the bits behind the leading one
    high = np.floor(np.log2(np.maximum(least >> np.uint64(11), np.uint64(1)).astype(np.float64))).astype(np.int64) + 11
    zeros = np.minimum(63 - high, (1 << ZERO_BITS) - 1)
    mantissa = (least >> np.maximum(high - MANTISSA_BITS, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = (zeros << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)
    out[~filled.any(axis=1)] = 0xFFFF
    return out


@lru_cache(maxsize=65536)
def expected_collisions(n: int, m: int) -> float:
    """The probability that a bucket's registers of two disjoint sets of ``n`` and ``m`` shingles agree."""
    a, b = max(1.0, n / BUCKETS), max(1.0, m / BUCKETS)
    edges = 2.0 ** -np.arange(0, 40)[:, None] * (1 - np.arange(0, 2**MANTISSA_BITS + 1)[None, :] / 2 ** (MANTISSA_BITS + 1))
    cell = lambda k: (1 - edges[:, 1:]) ** k - (1 - edges[:, :-1]) ** k
    return float((cell(a) * cell(b)).sum())


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from registers (pairs x buckets) and set sizes."""
    match = (a == b).mean(axis=1)
    grain = lambda x: 1 << max(0, int(x).bit_length() - 1)
    chance = np.array([expected_collisions(grain(x), grain(y)) for x, y in zip(n, m, strict=True)])
    return (match - chance) / (1 - chance)


def slack(n: np.ndarray) -> np.ndarray:
    """How far below the threshold the estimate of a pair may lie whose smaller set has ``n`` shingles.

    A small set fills few buckets, and borrowed registers repeat those: they count for less than their number.
    """
    filled = BUCKETS * (1 - (1 - 1 / BUCKETS) ** np.maximum(n, 1))
    return DEVIATIONS * np.sqrt(0.25 * 0.75 / (filled / (2 - filled / BUCKETS)))


def _fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of independent mixes of each row's set, whatever the order."""
    ends = np.cumsum(counts)
    return tuple(sums_by_row(mix64(values ^ odd), ends - counts, ends).view(np.int64) for odd in ODD[:2])


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat, offsets = text_bytes(batch.column("text"))
    n, one, two, regs = [], [], [], []
    for a, b in row_chunks(offsets):
        values, counts = shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        f1, f2 = _fingerprints(values, counts)
        n.append(counts)
        one.append(f1)
        two.append(f2)
        regs.append(registers(values, counts))
    whole = lambda parts: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64))
    regs = [r.tobytes() for part in regs for r in part]
    return pa.RecordBatch.from_arrays([batch.column("id"), whole(n), whole(one), whole(two), pa.array(regs, pa.binary())], names=["id", "n", "f1", "f2", "regs"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat, offsets = text_bytes(batch.column("text"))
    values, counts, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    for a, b in row_chunks(offsets):
        v, c = shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        values.append(v)
        counts.append(c)
        first.append(_fingerprints(v, c)[0])
    shingles = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(values).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(first)), shingles], names=["id", "f1", "shingles"])


def _likely(batch: pa.RecordBatch, threshold: int) -> pa.RecordBatch:
    regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b")]
    n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
    # sets whose sizes differ too much cannot reach the threshold
    possible = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
    good = possible & (estimates(*regs, n, m) >= threshold / 100 - slack(np.minimum(n, m)))
    return batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(good))


def _buckets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, n, degree) of each class in each band bucket that it shares; degree: whom it meets, all told."""
    width = 2 * BAND_ROWS  # both bytes of each register
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    banded = classes.select("node", "n", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = scratch.keep(banded.join(shared, "band"))
    return met.join(met.groupBy("node").agg(F.sum("members").alias("degree")), "node")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each bucket's pivot with each other member. The pivot is whoever shares most buckets with others, as the
    origin of a group of copies does; ties go to smaller sets and ids."""
    first = members.groupBy("band").agg(F.min(F.struct(-F.col("degree"), "n", "node"))["node"].alias("a"))
    return members.join(first, "band").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def linked(classes: DataFrame, docs: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(id, component) of each node of ``classes`` (node, n, regs) that links with another; ``docs``: id, text."""
    stars = scratch.keep(_stars(_buckets(classes, scratch)))
    wanted = scratch.keep(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct())
    kind = docs.schema["id"].dataType.simpleString()
    found = map_batches(perhaps_in(docs, wanted.select("node.id")), _sets, f"id {kind}, f1 long, shingles array<long>", rows=1000)
    # rows that repeat bring their set once more
    found = found.select(F.struct("id", "f1").alias("node"), "shingles").join(wanted, "node", "left_semi")
    sets = scratch.keep(found.groupBy("node").agg(F.first("shingles").alias("shingles")))
    sketches = scratch.keep(classes.select("node", "n", "regs").join(wanted, "node", "left_semi"))
    check = lambda some: confirm(some, sketches, sets, threshold, _likely, scratch)
    reached = scratch.keep(components(check(stars)))
    last = check(by_differences(stars, reached, sets, threshold, scratch))
    # the components so far are stars around their smallest nodes, which the last links tie together
    return reached if last.isEmpty() else components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(last))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component`` (smallest id reachable over links), ``kept``."""
    docs = with_names(docs, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        sketched = scratch.keep(map_batches(docs, _sketch, f"id {kind}, n long, f1 long, f2 long, regs binary"))
        classes = sketched.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.first("regs").alias("regs"))
        # a node of the graph is its class's smallest id, with the set it stands for
        classes = scratch.keep(classes.select(F.struct("id", "f1").alias("node"), "n", "f1", "f2", "regs"))
        reached = linked(classes, docs, threshold, scratch).select(F.col("id").alias("node"), "component")
        of_class = classes.join(reached, "node", "left").select("n", "f1", "f2", F.coalesce("component.id", "node.id").alias("component"))
        out = materialise(sketched.select("id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left").select("id", "n", "component"))
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; all columns stay.

    Rows that repeat an id are one document and leave one row, which stays where one of its texts is kept. A row
    without an id stays.
    """
    ids = near_duplicates(docs, id_col, text_col, threshold).where("id is not null").groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    ids = materialise(ids.where("not kept or rows > 1"))
    key = free_name(docs, "key")
    named = lambda rows: rows.select(F.col("id").alias(key))
    match = F.col(f"`{id_col}`") == F.col(key)
    repeated = named(ids.where("kept"))
    out = docs.join(named(ids), match, "left_anti")
    return out if repeated.isEmpty() else out.unionByName(docs.join(repeated, match, "left_semi").dropDuplicates([id_col]))
