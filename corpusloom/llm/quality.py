"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of all
vote patterns (3 to the number of labellers at most, whatever the table's size) estimates each labeller's
accuracy and the posterior of each pattern. The posteriors of a sample of at most ``SAMPLE`` documents train a
hashed linear scorer (byte n-grams and binned statistics), and the scorer decides on every document.

Defined cases: a null or empty text is scored like any other (its statistics are 0), and is rejected; rows that
repeat are scored alike; long texts are read whole; without rows nothing is fitted and the result is empty;
columns other than the named ones are ignored, and ``keep_good`` keeps all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import row_chunks, text_bytes, with_names
from corpusloom.llm.hashed import WIDTH, fit, ngram_features, ngram_scores, slices
from corpusloom.llm.near_dup import word_ends, word_hashes

#: Documented bound: most documents that train the scorer.
SAMPLE = 6000
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = True
#: Bytes that a word of prose may end with: letters, digits, stops, closing marks.
TIDY = np.zeros(256, bool)
TIDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *map(ord, ".,;:?)'\"")]] = True
#: Labellers: the side of the statistic on which each votes bad, from where on, and from where on it votes good
#: (None: it only knows one kind of junk and has nothing to say of other texts).
LABELLERS = {
    "signs": ("above", 0.06, None),
    "bars": ("above", 0.10, None),
    "capitals": ("above", 0.45, None),
    "shouts": ("above", 0.25, None),
    "echoes": ("above", 0.20, None),
    "variety": ("below", 0.70, 0.82),
    "plain": ("below", 0.60, 0.85),
    "length": ("below", 1.0, None),
}
NAMES = list(LABELLERS)
BINS = 16


def statistics(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The labellers' statistics of each row (rows x labellers)."""
    rows = len(offsets) - 1

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    size = np.diff(offsets)
    low = flat | 32
    letter = ((low >= 97) & (low <= 122)) | (flat >= 128)
    upper = (flat >= 65) & (flat <= 90)
    words, counts = word_hashes(flat, offsets)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(rows), counts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words, row))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=rows)
    echo = np.concatenate([[0], np.cumsum(same)])
    last = word_ends(flat, offsets)
    tidy = np.concatenate([[0], np.cumsum(TIDY[flat[last - 1]])])
    letters = share(letter, np.ones(rows)) * 1.0
    # logarithms: the distinct words of prose grow as a power of its length, at any length; one word is varied
    variety = np.where(counts > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(counts, 2)), 1.0)
    out = [
        share(SIGNS[flat], size),
        share(flat == ord("|"), counts),
        share(upper, letters),
        share(flat == ord("!"), counts),
        (echo[ends] - echo[ends - counts]) / np.maximum(counts, 1),
        variety,
        (tidy[ends] - tidy[ends - counts]) / np.maximum(counts, 1),
        counts.astype(np.float64),
    ]
    return np.stack(out, axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 nothing (rows x labellers)."""
    out = np.full(stats.shape, -1, np.int8)
    for k, (side, bad, good) in enumerate(LABELLERS.values()):
        x = stats[:, k]
        out[x > bad if side == "above" else x < bad, k] = 0
        if good is not None:
            out[x <= good if side == "above" else x >= good, k] = 1
    # next to nothing can be said of what is no text at all
    out[stats[:, NAMES.index("length")] == 0] = -1
    out[stats[:, NAMES.index("length")] == 0, NAMES.index("length")] = 0
    return out


def codes(v: np.ndarray) -> np.ndarray:
    """A number for each pattern of votes."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def patterns(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(NAMES))) % 3 - 1


def estimate(code: np.ndarray, count: np.ndarray, rounds: int = 100) -> dict:
    """Expectation-maximisation over pattern counts: the posterior of good of each pattern, and accuracies.

    Each labeller has its own chances to vote bad, good or nothing in either class; every kind of junk is seen by
    two labellers at least. Begins with one "bad" outweighing any "good".
    """
    v = patterns(code)
    good = np.where((v == 0).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * count, good * count])
        prior = (weight.sum(axis=1) + 1) / (count.sum() + 2)
        chance = np.stack([[(weight * (v[:, k] == s)).sum(axis=1) + 0.1 for s in (-1, 0, 1)] for k in range(v.shape[1])])
        chance /= chance.sum(axis=1, keepdims=True)  # labeller, vote, class
        log = np.log(prior)[:, None] + sum(np.log(chance[k][v[:, k] + 1]).T for k in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    spoken = chance[:, 1, :] + chance[:, 2, :]
    accuracy = (prior[0] * chance[:, 1, 0] + prior[1] * chance[:, 2, 1]) / (prior[0] * spoken[:, 0] + prior[1] * spoken[:, 1])
    return {"posterior": dict(zip(code.tolist(), good.tolist(), strict=True)), "accuracy": dict(zip(NAMES, accuracy.tolist(), strict=True)), "prior": float(prior[1])}


def bin_ids(stats: np.ndarray) -> np.ndarray:
    """The hashed feature of each binned statistic (rows x labellers), behind the n-grams' features."""
    shares = np.minimum(BINS - 1, np.floor(np.sqrt(np.clip(stats, 0, 1)) * BINS)).astype(np.int64)
    long = np.minimum(BINS - 1, np.floor(np.log2(1 + stats[:, -1]))).astype(np.int64)
    shares[:, -1] = long
    return WIDTH + np.arange(stats.shape[1]) * BINS + shares


ALL = WIDTH + len(NAMES) * BINS


def training_rows(docs: DataFrame, total: int, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` of the ``total`` rows, by a hash of id and text (``draw``).

    Each (id, text) is drawn once, however often it repeats, so that the bound holds for null ids and hot rows too.
    """
    drawn = docs.withColumn("draw", F.xxhash64("id", "text"))
    some = drawn.where(F.pmod("draw", F.lit(1 << 20)) < (1 << 20) * min(1.0, 1.1 * sample / total))
    if some.isEmpty():  # few different rows, and none of them drawn
        some = drawn
    last = some.select("draw").distinct().orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    return some.where(F.col("draw") <= last).dropDuplicates(["draw"])


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """``docs``: id, text. The model: EM's estimates over all rows, and the scorer's weights."""

    def vote(batches):
        for batch in slices(batches):
            flat, offsets = text_bytes(batch.column("text"))
            parts = [codes(votes(statistics(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))) for a, b in row_chunks(offsets)]
            code, n = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    counted = docs.mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    if not counted:
        return {}
    total = sum(r["n"] for r in counted)
    found = estimate(np.array([r["code"] for r in counted]), np.array([float(r["n"]) for r in counted]))
    posterior = found["posterior"]

    def features(batches):
        for batch in slices(batches, 200):
            out: list[list] = [[] for _ in range(5)]
            for key, text in zip(zip(*(batch.column(c).to_pylist() for c in ("id", "draw")), strict=True), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                stats = statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                index, value = ngram_features(raw, False)
                index, value = np.concatenate([index, bin_ids(stats)[0]]), np.concatenate([value, np.ones(len(NAMES))])
                for c, v in zip(out, (str(key), "quality", posterior[int(codes(votes(stats))[0])], index, value), strict=True):
                    c.append(v)
            types = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "model", "y", "index", "value"])

    data = training_rows(docs, total, sample).mapInArrow(features, "key string, model string, y double, index array<int>, value array<float>")
    return found | {"weights": fit(data, ALL, hinge=False)["quality"]}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: ``id``, ``quality`` (0 to 1), ``weak`` (posterior of the votes alone), ``kept``."""
    docs = with_names(docs, id=id_col, text=text_col)
    model = train(docs)
    if not model:
        return docs.sparkSession.createDataFrame([], _result(docs, ["id"]))
    return _apply(docs, model, threshold, ["id"])


def _result(docs: DataFrame, carry: list[str]) -> T.StructType:
    scores = [T.StructField("quality", T.DoubleType()), T.StructField("weak", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return T.StructType([*(docs.schema[c] for c in carry), *scores])


def _apply(docs: DataFrame, model: dict, threshold: float, carry: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["posterior"]))  # of fixed size

    def run(batches):
        w, posterior = shared.value
        for batch in slices(batches):
            flat, offsets = text_bytes(batch.column("text"))
            good, weak = [np.zeros(0)], [np.zeros(0)]
            for a, b in row_chunks(offsets):
                part, at = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                stats = statistics(part, at)
                margin = ngram_scores(part, at, w[:WIDTH, None], False)[:, 0] + w[bin_ids(stats)].sum(axis=1) + w[-1]
                empty = stats[:, -1] == 0
                good.append(np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(margin, -30, 30)))))
                weak.append(np.array([posterior.get(int(c), 0.5) for c in codes(votes(stats))]))
            q = np.concatenate(good)
            cols = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(q), pa.array(np.concatenate(weak)), pa.array(q >= threshold)], names=[*carry, "quality", "weak", "kept"])

    return docs.mapInArrow(run, _result(docs, carry))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rejected ones; the rows go through the scorer whole, so nothing is joined."""
    narrow = with_names(docs, id=id_col, text=text_col)
    model = train(narrow)
    if not model:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return _apply(whole, model, threshold, ["row"]).where("kept").select("row.*")
