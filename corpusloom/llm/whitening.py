"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

A component c becomes the integer floor(1024 c) + 100000. Sums and sums of products are kept as exact integers (products of
values centred at the rounded mean, whose remainder is taken off exactly), so that the fit is the same however rows are
dealt. The scatter comes together from one small matrix of each task, summed by Spark; a vector length's matrix, whose size does not
depend on the rows, is factored in a task of its own. The scatter's factor L (pivoted Cholesky) is rotated from the right, column pair by column pair,
until its columns are orthogonal: their squared norms are the eigenvalues, the columns at length 1 the components.

Defined cases: a vector that is null or empty, or holds null or non-finite entries, takes no part; null ids do; rows that repeat count as
often as they stand there; a value beyond a long becomes the largest or smallest long; vectors of different lengths are fitted
apart; components without variance (one row, equal rows, fewer directions than components) have a null ``whitened``,
explain 0 and take no part in ``identity_error`` (0 where there is none at all); ties between equal eigenvalues go by
the place of their column; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, materialise, with_names

SCALE, SHIFT, COMPONENTS = 1024.0, 100000, 8
LONG = 2**63 - 1
#: Sums of products up to this are exact in doubles.
EXACT = 2**53
#: Rows that a task works on at once.
ROWS = 2000


def quantise(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The rows that take part, and for each vector length (rows of it, their integers)."""
    vectors = column.to_pylist()
    use = np.array([bool(v) and None not in v and bool(np.isfinite(v).all()) for v in vectors], bool)
    lengths = np.array([len(v) if u else 0 for v, u in zip(vectors, use, strict=True)], np.int64)
    out = {}
    for dim in np.unique(lengths[use]).tolist():
        at = np.flatnonzero(lengths == dim)
        x = np.array([vectors[i] for i in at], np.float64)
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * x)
        if np.abs(x).max() < 2**52:
            out[dim] = (at, x.astype(np.int64) + SHIFT)
        else:  # a double beyond 2^53 is an integer as it stands; infinity is beyond a long
            whole = [[max(-LONG - 1, min(LONG, int(v) + SHIFT)) if np.isfinite(v) else (LONG if v > 0 else -LONG - 1) for v in row] for row in x.tolist()]
            out[dim] = (at, np.array(whole, np.int64))
    return use, out


def _halves(values: list[int]) -> tuple[list[int], list[int]]:
    """An integer as high * 2^32 + low, so that sums over tasks stay within longs."""
    return [v >> 32 for v in values], [v & 0xFFFFFFFF for v in values]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector length the number of rows (place -1) and the sum of each component."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for dim, (at, x) in quantise(batch.slice(start, ROWS).column("vec"))[1].items():
                small = np.abs(x).max() < 2**50 if x.min() > -LONG else False
                s = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
                was = total.get(dim, [0] * (dim + 1))
                total[dim] = [a + b for a, b in zip(was, [len(at), *s], strict=True)]
    for dim, values in total.items():
        high, low = _halves(values)
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * (dim + 1), pa.int32()), "i": pa.array(range(-1, dim), pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products of columns, exact: integers of Python where they exceed what doubles hold."""
    most = int(np.abs(y.astype(object)).max()) if y.dtype == object else int(np.abs(y).max(initial=0))
    if most < 2**26 and most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _scatter(batches: Iterator[pa.RecordBatch], centres: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """For each vector length the sums of products of the values less their rounded means, on and above the diagonal."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for dim, (_, x) in quantise(batch.slice(start, ROWS).column("vec"))[1].items():
                part = _products(centred(x, centres[dim]))
                total[dim] = total[dim] + part if dim in total else part
    for dim, m in total.items():
        for i in range(dim):
            # in parts of 48 bits, as products of longs have up to 128 bits
            row = [int(v) for v in m[i, i:]]
            top, high, low = [v >> 96 for v in row], [v >> 48 & 2**48 - 1 for v in row], [v & 2**48 - 1 for v in row]
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(row), pa.int32()), "i": pa.array([i] * len(row), pa.int32()), "j": pa.array(range(i, dim), pa.int32()), "top": pa.array(top, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    if np.abs(x.astype(np.float64)).max(initial=0) < 2**61 and max(map(abs, centre)) < 2**61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in their own order) with L L^T = a, the largest remaining diagonal first; as many columns as the rank."""
    d, n = a.diagonal().astype(np.float64).copy(), len(a)
    low = np.zeros((n, n))
    least = max(float(d.max(initial=0)), 0.0) * n * 2.0**-52
    for k in range(n):
        p = int(d.argmax())
        if not d[p] > least:
            return low[:, :k]
        low[:, k] = (a[:, p] - low[:, :k] @ low[p, :k]) / np.sqrt(d[p])
        d -= low[:, k] ** 2
        d[p] = 0.0
    return low


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and components (columns) of factor factor^T, by rotating the factor's columns.

    In each round of a sweep all columns are paired (a round robin), and the pairs are rotated together.
    """
    u = factor.copy()
    m, least = u.shape[1], 2.0**-52 * np.sqrt(max(1, len(u)))
    ring = list(range(m + m % 2))  # an odd column sits a round out
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[half:][::-1], strict=True) if max(a, b) < m]
            p, q = np.array(pairs, np.int64).reshape(-1, 2).T
            x, y = u[:, p], u[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(alpha * beta)
            turn = (np.abs(gamma) > least * size) & (size > 0)
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max(initial=0)))
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1), 0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            u[:, p], u[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst == 0:
            break
    norms = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


def decompose(n: int, sums: list[int], centre: list[int], upper: dict[tuple[int, int], int], components: int = COMPONENTS) -> dict:
    """The model of one vector length: n, centre, remainder of the sums, components, eigenvalues and their shares."""
    dim = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    # n^2 times the covariance, in whole numbers; divided once
    square = n * n
    v = np.zeros((dim, dim))
    for (i, j), p in upper.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / square
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, dim)
    e, w = np.zeros(k), np.zeros((dim, k))
    have = min(k, len(values))
    e[:have], w[:, :have] = values[:have], vectors[:, :have]
    trace = float(np.trace(v))
    return {"n": n, "rest": rest, "values": e.tolist(), "explained": (e / trace if trace > 0 else e).tolist(), "components": w.T.ravel().tolist()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``dim, n, centre, rest, values, explained, components`` of each vector length; ``vectors``: vec."""
    # sums of decimals stay exact; a row for each component of a vector length, whatever the number of vectors
    sums = vectors.select("vec").mapInArrow(_sums, "dim int, i int, high long, low long").groupBy("dim", "i").agg(F.sum(F.col("high").cast("decimal(28,0)")).alias("high"), F.sum(F.col("low").cast("decimal(28,0)")).alias("low"))
    totals: dict[int, dict[int, int]] = {}
    for r in sums.collect():
        totals.setdefault(r["dim"], {})[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    schema = "dim int, n long, centre array<long>, rest array<long>, values array<double>, explained array<double>, components array<double>"
    if not totals:
        return vectors.sparkSession.createDataFrame([], schema)
    n = {dim: t[-1] for dim, t in totals.items()}
    sum_of = {dim: [t[i] for i in range(dim)] for dim, t in totals.items()}
    centres = {dim: [(2 * s + n[dim]) // (2 * n[dim]) for s in sums] for dim, sums in sum_of.items()}
    parts = vectors.select("vec").mapInArrow(lambda b: _scatter(b, centres), "dim int, i int, j int, top long, high long, low long")
    summed = parts.groupBy("dim", "i", "j").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("top", "high", "low")])

    def solve(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        upper = {(i, j): (int(t) << 96) + (int(h) << 48) + int(low) for i, j, t, h, low in zip(*(group[c].to_pylist() for c in ("i", "j", "top", "high", "low")), strict=True)}
        m = decompose(n[dim], sum_of[dim], centres[dim], upper, components)
        lists = {"centre": (centres[dim], pa.int64()), **{c: (m[c], pa.int64() if c == "rest" else pa.float64()) for c in ("rest", "values", "explained", "components")}}
        return pa.table({"dim": pa.array([dim], pa.int32()), "n": pa.array([m["n"]], pa.int64()), **{c: pa.array([v], pa.list_(t)) for c, (v, t) in lists.items()}})

    return materialise(summed.groupBy("dim").applyInArrow(solve, schema))


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """Sum over components of (n y - rest)^2, exact."""
    r, square = [int(v) for v in rest], sum(int(v) ** 2 for v in rest)
    most, most_r = int(np.abs(y).max(initial=0)) if y.dtype != object else LONG, max(map(abs, r))
    if most and max(most, most_r) * most * len(r) < 2**62:
        own, cross = (y * y).sum(axis=1).tolist(), (y @ np.array(r, np.int64)).tolist()
    else:
        z = y.astype(object)
        own, cross = (z * z).sum(axis=1).tolist(), (z @ np.array(r, object)).tolist()
    return [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(own, cross, strict=True)]


def _project(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Centred integers and whitened values (NaN where a component has no variance)."""
    y = centred(x, m["centre"])
    w = np.array(m["components"]).reshape(-1, x.shape[1])
    e = np.array(m["values"])
    scale = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), np.nan)
    return y, ((y.astype(np.float64) - np.array([r / m["n"] for r in m["rest"]])) @ w.T) * scale


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``id, component, n, deviation`` (decimal, exact), ``whitened, explained, identity_error``.

    ``identity_error`` is measured: the covariance of the whitened values of all rows, from a pass over them. The models
    are collected, one for each vector length; these must be few enough for the driver.
    """
    given = with_names(vectors, id=id_col, vec=vec_col)
    kind = given.schema["id"].dataType.simpleString()
    models = {r["dim"]: r.asDict() for r in fit(given, components).collect()}
    shared = given.sparkSession.sparkContext.broadcast(models)  # of a size that the vector lengths set

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for dim, (_, x) in quantise(batch.slice(start, ROWS).column("vec"))[1].items():
                    z = np.nan_to_num(_project(x, shared.value[dim])[1])
                    z = np.column_stack([np.ones(len(z)), z])
                    total[dim] = total.get(dim, 0) + z.T @ z
        for dim, m in total.items():
            i, j = (v.ravel() for v in np.indices(m.shape))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(m.ravel())})

    errors = {}
    measured: dict[int, dict] = {}
    for r in given.select("vec").mapInArrow(covariance, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        measured.setdefault(r["dim"], {})[(r["i"], r["j"])] = r["s"]
    for dim, m in measured.items():
        live, n = [k + 1 for k, e in enumerate(models[dim]["values"]) if e > 0], models[dim]["n"]
        errors[dim] = max((abs(m[(i, j)] / n - m[(0, i)] * m[(0, j)] / n**2 - (i == j)) for i in live for j in live), default=0.0)
    worst = max(errors.values(), default=0.0)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        use, found = quantise(batch.column("vec"))
        rows, cols = [], [[] for _ in range(5)]
        for dim, (at, x) in found.items():
            m = shared.value[dim]
            y, z = _project(x, m)
            k = z.shape[1]
            rows.append(np.repeat(at, k))
            far = [Decimal(v) if v < 10**38 else None for v in deviations(y, m["n"], m["rest"])]
            parts = ([*range(1, k + 1)] * len(at), [m["n"]] * (k * len(at)), [v for v in far for _ in range(k)], z.ravel().tolist(), m["explained"] * len(at))
            for c, v in zip(cols, parts, strict=True):
                c.extend(v)
        index = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]))
        value = pa.array([None if v != v else v for v in cols[3]], pa.float64())
        arrays = [batch.column("id").take(index), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.decimal128(38, 0)), value, pa.array(cols[4], pa.float64()), pa.array([worst] * len(index), pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names="id component n deviation whitened explained identity_error".split())

    return map_batches(given, apply, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double", rows=ROWS)
