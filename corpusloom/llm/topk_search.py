"""Exact top-k search by inner product over a pivot-distance index.

Vectors are quantised to integers. Each vector is keyed by its nearest pivot and its distance to it; vectors of
one pivot whose distances fall into one ring are an annulus. Only each annulus's count, distance range and
largest norm are gathered, which pivots and rings bound. A query first searches the annuli nearest to its own
until they hold enough vectors, which gives a score that its k-th best reaches at least. Then it searches every
other annulus whose bound does not rule that score out. The bound is the triangle inequality's: for x in an
annulus with distances lo..hi around pivot p, |q - x| >= max(0, |q - p| - hi, lo - |q - p|), and
2<q, x> = |q|^2 + |x|^2 - |q - x|^2; and <q, p> + |q| hi.

Annuli are cut into blocks of bounded size, and queries too: a task joins one block with one block. Blocks lie in lots of
about as many vectors, so that a block of queries is sent once to each lot where one of them searches; joins are by shuffle
and sort, and the driver holds pivots and a row for each annulus alone.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; every row
is a candidate of its own, so rows that repeat an id, and its vector or not, stand in the result as often, but never
as candidates of a query of their id; equal scores go to the smaller id; with fewer candidates than k all are
returned; vectors of different lengths are not compared; an empty table gives an empty result; columns other than the
named ones are ignored. A wide vector, with a quantised component of 2^20 or more (or so many components that sums of
doubles would not be exact), stays outside the index: it is held against every query, and as a query against every
vector, in sums of Python integers. Its components are exact whatever their size (256-fold beyond a double: the largest
double). A score beyond a long ranks by its value (beyond 38 digits as 38 nines) and becomes the largest or smallest long.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, materialise, with_names

#: Vectors in a block and queries in a block, about; most pivots and rings of a pivot.
BLOCK, QUERY_BLOCK, MOST_PIVOTS, RINGS = 1024, 256, 256, 8
#: Blocks in a lot, about, and most lots of vectors of one length: beyond them lots grow with the table.
LOT, MOST_LOTS = 4, 256
FACTOR = 256.0
#: Components of an indexed vector are smaller; sums of products of doubles up to EXACT are exact integers.
NARROW, EXACT = 1 << 20, 2.0**53
#: The pivot of wide vectors, which have none.
WIDE = -1
MOST_DIGITS = 10**38 - 1


def _quantise(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with a usable vector: ``id, salt, vec`` (integers, as doubles if ``wide``), ``dim``."""
    ids, salts, out, dims, wide = [], [], [], [], []
    for key, salt, vector in zip(*(batch.column(c).to_pylist() for c in ("id", "salt", "vec")), strict=True):
        if key is None or not vector or None in vector:
            continue
        x = np.array(vector, np.float64)
        if np.isfinite(x).all():
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(FACTOR * x))
            ids.append(key)
            salts.append(salt)
            top = float(np.abs(x).max())
            wide.append(top >= NARROW or top >= (EXACT / len(x)) ** 0.5)
            out.append(x.astype("<f8" if wide[-1] else "<i4").tobytes())
            dims.append(len(x))
    cols = [pa.array(ids, pa.int64()), pa.array(salts, pa.int64()), pa.array(out, pa.binary()), pa.array(dims, pa.int64()), pa.array(wide, pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "salt", "vec", "dim", "wide"])


def _vectors(data: bytes, rows: int, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<f8" if wide else "<i4").reshape(rows, -1).astype(np.float64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _key(batch: pa.RecordBatch, pivots: dict[int, np.ndarray], width: float) -> pa.RecordBatch:
    data, dims, wide = batch.column("vec").to_pylist(), batch.column("dim").to_numpy(), batch.column("wide").to_numpy(zero_copy_only=False)
    pivot, ring, dist, norm = (np.zeros(len(data), t) for t in (np.int64, np.int64, float, float))
    pivot[wide] = WIDE
    for dim in np.unique(dims[~wide]):
        here = np.flatnonzero((dims == dim) & ~wide)
        x = _vectors(b"".join(data[i] for i in here), len(here), False)
        d = _distances(x, pivots[int(dim)])
        pivot[here] = d.argmin(axis=1)
        dist[here] = d.min(axis=1)
        norm[here] = (x**2).sum(axis=1)
        ring[here] = np.minimum(RINGS - 1, dist[here] // width)
    cols = [batch.column("id"), batch.column("salt"), batch.column("vec"), batch.column("dim"), pa.array(pivot), pa.array(ring), pa.array(dist), pa.array(norm)]
    return pa.RecordBatch.from_arrays(cols, names=["id", "salt", "vec", "dim", "pivot", "ring", "dist", "norm"])


def _bounds(q: np.ndarray, pivots: np.ndarray, annuli: dict[str, np.ndarray]) -> np.ndarray:
    """The most that a vector of each annulus can score (queries x annuli), a little more for the rounding."""
    d = _distances(q, pivots)[:, annuli["pivot"]]
    square = (q**2).sum(axis=1)[:, None]
    gap = np.maximum(0, np.maximum(d - annuli["hi"], annuli["lo"] - d))
    by_triangle = (square + annuli["norm"] - gap**2) / 2
    by_angle = (q @ pivots.T)[:, annuli["pivot"]] + np.sqrt(square) * annuli["hi"]
    bound = np.minimum(by_triangle, by_angle) * (1 + 1e-9) + 1e-3 + (square + annuli["norm"]) * 1e-9
    bound[:, annuli["pivot"] == WIDE] = np.inf
    return bound


def _best(q_ids: list, q: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, wide: bool) -> list[tuple]:
    """(query, id, score) of each query's best ``k`` in a block that reach its floor, ties to smaller ids."""
    out = []
    if wide:
        whole = [np.array([[int(v) for v in row] for row in m.tolist()], object) for m in (q, x)]
        scores = whole[0] @ whole[1].T
    else:
        scores = q @ x.T
    for r, key in enumerate(q_ids):
        at = np.flatnonzero(ids != key) if wide else np.flatnonzero((scores[r] >= floor[r]) & (ids != key))
        if len(at) > 4 * k and not wide:  # of equal scores at the cut all stay
            cut = np.partition(scores[r][at], len(at) - k)[len(at) - k]
            at = at[scores[r][at] >= cut]
        best = sorted((-max(-MOST_DIGITS, min(MOST_DIGITS, int(s))), int(ids[o])) for s, o in zip(scores[r][at].tolist(), at, strict=True))[:k]
        out += [(key, i, -s) for s, i in best]
    return out


def _search(batch: pa.RecordBatch, k: int, long: bool) -> pa.RecordBatch:
    rows: list[tuple] = []
    for r in range(batch.num_rows):
        get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
        q_ids, floor, ids = get("q_ids"), np.array(get("q_floor"), float), np.array(get("ids"))
        q_wide, x_wide = get("q_wide"), get("pivot") == WIDE
        marks = np.frombuffer(get("marks"), bool).reshape(len(q_ids), -1)
        who = np.flatnonzero(marks[:, get("q_annuli").index(get("annulus"))])
        if len(who):
            rows += _best([q_ids[w] for w in who], _vectors(get("q_vecs"), len(q_ids), q_wide)[who], ids, _vectors(get("vecs"), len(ids), x_wide), floor[who], k, q_wide or x_wide)
    query, found, score = list(zip(*rows, strict=True)) or [[], [], []]
    scores = pa.array(score, pa.int64()) if long else pa.array([Decimal(s) for s in score], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), scores], names=["query", "id", "score"])


def _gather(table: pa.Table, names: tuple[str, str], extra: list[str]) -> pa.Table:
    """One row for a group: its ids and its vectors end to end."""
    table = table.sort_by([("id", "ascending"), ("salt", "ascending")])
    data = b"".join(table["vec"].to_pylist())
    cols = {c: table[c].slice(0, 1) for c in extra}
    return pa.table(cols | {names[0]: pa.array([table["id"].to_pylist()], pa.list_(pa.int64())), names[1]: pa.array([data], pa.binary())})


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """``query, rank, id, score``: the ``k`` best of each query, a row whose id ``every`` divides, against all rows."""
    spark = vectors.sparkSession
    named = with_names(vectors, id=id_col, vec=vec_col).select(F.col("id").cast("long").alias("id"), F.monotonically_increasing_id().alias("salt"), "vec")
    ints = materialise(map_batches(named, _quantise, "id long, salt long, vec binary, dim long, wide boolean"))
    lengths = {r["dim"]: (r["n"], r["any_wide"]) for r in ints.groupBy("dim").agg(F.count_if(~F.col("wide")).alias("n"), F.bool_or("wide").alias("any_wide")).collect()}
    out_schema = "query long, rank int, id long, score long"
    if not lengths:
        return spark.createDataFrame([], out_schema)
    long = not any(w for _, w in lengths.values())
    # a bounded sample of each length: at most as many vectors as pivots
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id", "salt"), "id"))
    chosen: dict[int, list[bytes]] = {}
    for r in ints.where("not wide").withColumn("place", place).where(F.col("place") <= MOST_PIVOTS).orderBy("dim", "place").collect():
        if r["place"] <= min(MOST_PIVOTS, max(4, lengths[r["dim"]][0] ** 0.5 / 4)):
            chosen.setdefault(r["dim"], []).append(bytes(r["vec"]))
    pivots = {dim: _vectors(b"".join(chosen[dim]), len(chosen[dim]), False) if dim in chosen else np.zeros((1, dim)) for dim in lengths}
    typical = np.median(np.concatenate([np.sort(_distances(p, p), axis=1)[:, 1:].ravel() for p in pivots.values() if len(p) > 1] or [np.ones(1)]))
    width = max(float(typical), 1.0) * 1.25 / RINGS
    keyed = materialise(map_batches(ints, lambda b: _key(b, pivots, width), "id long, salt long, vec binary, dim long, pivot long, ring long, dist double, norm double"))
    stats = keyed.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm")).orderBy("dim", "pivot", "ring").collect()
    annuli = {dim: {c: np.array([r[c] for r in stats if r["dim"] == dim]) for c in ("pivot", "ring", "n", "lo", "hi", "norm")} for dim in lengths}
    cuts = []
    for dim, a in annuli.items():
        # an annulus begins at a place among the vectors, and so do its blocks; a lot is a range of places
        span = max(LOT * BLOCK, -(-int(a["n"].sum()) // MOST_LOTS))
        pieces, begin = -(-a["n"] // BLOCK), np.cumsum(a["n"]) - a["n"]
        cuts += [(dim, int(p), int(r), m, int(n), int(c), int(b), span) for m, (p, r, n, c, b) in enumerate(zip(a["pivot"], a["ring"], a["n"], pieces, begin, strict=True))]
        first, last = begin // span, (begin + (pieces - 1) * a["n"] // pieces) // span
        a["lots"] = {lot: np.flatnonzero((first <= lot) & (lot <= last)) for lot in range(int(last.max()) + 1)}
    cuts = spark.createDataFrame(cuts, "dim long, pivot long, ring long, annulus int, n long, cuts long, begin long, span long")
    key = ["dim", "lot"]
    block = keyed.join(F.broadcast(cuts), ["dim", "pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("id", "salt"), F.col("cuts"))).withColumn("lot", F.expr("(begin + (block * n) div cuts) div span"))
    of_annulus = [*key, "annulus", "pivot"]
    blocks = materialise(block.groupBy(*of_annulus, "block").applyInArrow(lambda t: _gather(t, ("ids", "vecs"), of_annulus), "dim long, lot long, annulus int, pivot long, ids array<long>, vecs binary"))

    asked = keyed.where(F.col("id") % every == 0)
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    # queries of one block lie around one pivot, where there are enough of them
    placed = asked.withColumn("q_wide", F.col("pivot") == WIDE).withColumn("block", F.pmod(F.col("pivot") * 7919 + F.pmod(F.xxhash64("id", "salt"), F.lit(max(1, -(-groups // 8)))), F.lit(groups)))
    of_block = ["dim", "q_wide", "block"]
    queries = materialise(placed.groupBy(*of_block).applyInArrow(lambda t: _gather(t, ("q_ids", "q_vecs"), of_block), "dim long, q_wide boolean, block long, q_ids array<long>, q_vecs binary"))

    def visits(first: bool):
        """Lots for each block of queries, with the queries that search there and in which annuli; ``first``: the seeds, else the rest."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(8)]
            for r in range(batch.num_rows):
                dim, wide, q_ids = batch.column("dim")[r].as_py(), batch.column("q_wide")[r].as_py(), np.array(batch.column("q_ids")[r].as_py())
                data = batch.column("q_vecs")[r].as_py()
                size, a = len(data) // len(q_ids), annuli[dim]
                # a wide query visits all
                bound = np.full((len(q_ids), len(a["n"])), np.inf) if wide else _bounds(_vectors(data, len(q_ids), False), pivots[dim], a)
                order = np.argsort(-bound, axis=1, kind="stable")
                # sorted annuli, expanded until they hold k others than the query itself
                held = np.cumsum(a["n"][order], axis=1)
                seeds = np.zeros_like(bound, bool)
                np.put_along_axis(seeds, order, (held - a["n"][order]) < k + 1, axis=1)
                floor = np.full(len(q_ids), -np.inf) if first else np.array(batch.column("q_floor")[r].as_py(), float)
                search = seeds if first else ~seeds & (bound >= floor[:, None])
                for lot, within in a["lots"].items():
                    who = np.flatnonzero(search[:, within].any(axis=1))
                    if not len(who):
                        continue
                    some = b"".join(data[w * size : (w + 1) * size] for w in who.tolist())
                    row = (dim, lot, wide, q_ids[who].tolist(), some, floor[who].tolist(), within.tolist(), search[np.ix_(who, within)].tobytes())
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
            types = [pa.int64()] * 2 + [pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=[*key, "q_wide", "q_ids", "q_vecs", "q_floor", "q_annuli", "marks"])

        return run

    score = "long" if long else "decimal(38,0)"

    def search(pairs: DataFrame) -> DataFrame:
        # by shuffle and sort: a block of queries becomes a row for each lot, which Spark's guess of its size does not know
        return map_batches(pairs.join(blocks.hint("merge"), key), lambda b: _search(b, k, long), f"query long, id long, score {score}", rows=64)

    plan = "dim long, lot long, q_wide boolean, q_ids array<long>, q_vecs binary, q_floor array<double>, q_annuli array<int>, marks binary"
    # few bytes and much work: one task for each block of queries
    dealt = lambda blocks_of: blocks_of.repartition(groups, *of_block).drop("block")
    seeds = materialise(search(map_batches(dealt(queries), visits(True), plan, rows=1)))
    rank = "row_number() over (partition by query order by score desc, id)"
    floors = seeds.selectExpr("*", f"{rank} as rank").where(f"rank = {k}").select("query", F.col("score").cast("double").alias("floor"))
    # ids and floors alone are dealt by query, vectors stay in their blocks
    each = queries.select(*of_block, F.posexplode("q_ids").alias("at", "query")).join(floors.hint("merge"), "query", "left")
    by_place = each.groupBy(*of_block).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))).alias("f"))
    known = queries.join(by_place.hint("merge"), of_block).select(*of_block, "q_ids", "q_vecs", F.col("f.floor").alias("q_floor"))
    rest = search(map_batches(dealt(known), visits(False), plan, rows=1))
    as_long = f"cast(least(cast('{2**63 - 1}' as decimal(38,0)), greatest(cast('{-(2**63)}' as decimal(38,0)), score)) as long)"
    return seeds.union(rest).selectExpr("query", f"{rank} as rank", "id", f"{as_long} as score").where(f"rank <= {k}").select("query", "rank", "id", "score")
