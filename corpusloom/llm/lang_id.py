"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines
between the languages of that family, over hashed byte bigrams and trigrams.

The models learn only from the texts and languages of the rows marked for training, a sample of at most about
``SAMPLE`` rows of each language (chosen by a hash of id and text); prediction reads nothing but the text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no rows to learn from every
text is ``und``; a language alone in its family needs no machine; ties go to the name that sorts first; rows
that repeat are predicted alike; long texts are read whole; columns other than the named ones are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import row_chunks, text_bytes, with_names
from corpusloom.llm.hashed import WIDTH, fit, ngram_features, ngram_scores, slices

#: Documented bound: rows of each language that training takes, about.
SAMPLE = 1500
#: The family of a language; one that is not here is a family of its own.
FAMILIES = {
    "Germanic": ["de", "en", "nl", "da", "sv", "no", "nb", "nn", "is", "af"],
    "Romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "Slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "Uralic": ["fi", "et", "hu"],
    "Turkic": ["tr", "az", "kk", "uz"],
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def _letters(flat: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each row has a letter."""
    ascii_letter = ((flat | 32) >= 97) & ((flat | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for r in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[r] = any(c.isalpha() for c in texts[int(r)].as_py())
    return out


def _models(lang: str, langs: list[str]) -> list[tuple[str, float]]:
    """The models that a row of ``lang`` trains, with its target in each."""
    family = lambda x: FAMILY.get(x, x)
    families = sorted({family(x) for x in langs})
    out = [(f"family:{f}", float(f == family(lang))) for f in families] if len(families) > 1 else []
    peers = [x for x in langs if family(x) == family(lang)]
    return out + [(f"pair:{a}:{b}", float(lang == a)) for a, b in combinations(peers, 2) if lang in (a, b)]


def train(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """``rows``: key, text, lang. The model: languages and the weights of each machine."""
    known = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "weights": {}}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / counts[lang]))])[F.col("lang")]
    # each (key, text) is drawn once, so that null keys and rows that repeat keep within the bound
    drawn = known.withColumn("draw", F.xxhash64("key", "text")).where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))
    chosen = drawn.dropDuplicates(["draw"])

    def features(batches):
        for batch in slices(batches, 200):
            out: list[list] = [[] for _ in range(5)]
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("draw", "text", "lang")), strict=True):
                if any(c.isalpha() for c in text):
                    index, value = ngram_features(text.encode(), True)
                    for model, y in _models(lang, langs):
                        for c, v in zip(out, (str(key), model, y, index, value), strict=True):
                            c.append(v)
            types = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "model", "y", "index", "value"])

    data = chosen.select("draw", "text", "lang").mapInArrow(features, "key string, model string, y double, index array<int>, value array<float>")
    return {"langs": langs, "weights": fit(data, WIDTH, hinge=True)}


def _predict(flat: np.ndarray, offsets: np.ndarray, model: dict, names: list[str], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each row, and the score."""
    langs, rows = model["langs"], len(offsets) - 1
    margin = ngram_scores(flat, offsets, weights, True) + bias if names else np.zeros((rows, 0))
    column = {name: margin[:, k] for k, name in enumerate(names)}
    sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
    families = sorted({FAMILY.get(x, x) for x in langs})
    scores = np.stack([column.get(f"family:{f}", np.zeros(rows)) for f in families])
    family, score = scores.argmax(axis=0), sure(scores.max(axis=0)) if len(families) > 1 else np.ones(rows)
    lang = np.zeros(rows, np.int64)
    for k, f in enumerate(families):
        mine = [x for x in langs if FAMILY.get(x, x) == f]
        wins, worst = np.zeros((len(mine), rows)), np.full((len(mine), rows), 1e9)
        for a, b in combinations(range(len(mine)), 2):
            m = column[f"pair:{mine[a]}:{mine[b]}"]
            for i, signed in ((a, m), (b, -m)):
                wins[i] += signed > 0 if i != a else signed >= 0
                worst[i] = np.minimum(worst[i], signed)
        # most wins; of equal ones the name that sorts first
        best, here = wins.argmax(axis=0), family == k
        lang[here] = np.array([langs.index(x) for x in mine])[best[here]]
        score[here] *= sure(worst[best, np.arange(rows)])[here] if len(mine) > 1 else 1.0
    return lang, score


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, lang_pred, score``."""
    docs = with_names(docs, id=id_col, text=text_col)
    names = sorted(model["weights"])
    table = np.stack([model["weights"][n] for n in names], axis=1) if names else np.zeros((WIDTH + 1, 0), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((table[:-1], table[-1]))  # as large as its machines are many

    def run(batches):
        weights, bias = shared.value
        labels = np.array([*model["langs"], "und"], object)
        for batch in slices(batches):
            flat, offsets = text_bytes(batch.column("text"))
            lang, score = [], []
            if model["langs"]:
                for a, b in row_chunks(offsets):
                    k, s = _predict(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model, names, weights, bias)
                    lang.append(k)
                    score.append(s)
            k, s = (np.concatenate(lang), np.concatenate(score)) if lang else (np.zeros(batch.num_rows, int), np.zeros(batch.num_rows))
            known = _letters(flat, offsets, batch.column("text")) & bool(model["langs"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(labels[np.where(known, k, -1)], pa.string()), pa.array(np.where(known, s, 0.0))], names=["id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no training sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify_with_training(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the rows that are not held out and predicts every row."""
    rows = with_names(docs, key=id_col, text=text_col, lang=lang_col)
    model = train(rows.where(~held_out(F.col("key")) & F.col("key").isNotNull()))
    found = identify(docs, model, id_col, text_col)
    return found.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


