"""Exact dedup, whitening and fill-in-middle against brute force, with nulls, repeats, collisions, long texts and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, fill_in_middle, whitening
from corpusloom.llm.queries import op11_exact_dedup, op12_embedding_whitening, op13_fill_in_middle
from tests.conftest import DATA
from tests.llm.fixtures import documents

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.fixture(scope="module")
def docs(spark):
    spaced = spark.createDataFrame([(9001, "a b\tc"), (9002, "abc"), (9003, "a  bc"), (9004, "ab c "), (9003, "a  bc"), (9005, "a bc"), (9006, "ab\x1cc")], "doc_id long, text string")
    return documents(spark).unionByName(spaced, allowMissingColumns=True).cache()


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r["text"] or ""
        groups[text.translate(BLANKS)].append((-len(text), r["doc_id"] is None, r["doc_id"] or 0))
    expected = Counter()
    for norm, members in groups.items():
        lead = min(members)
        for k, m in enumerate(sorted(members)):
            ids = [None if x[1] else x[2] for x in (m, lead)]
            expected[(ids[0], ids[1], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return expected


def test_exact_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    found = exact_dedup.classes(docs)
    assert Counter((r["id"], r["keep"], r["size"], r["kept"], r["sha256"]) for r in found.collect()) == brute_groups(rows)
    # a hash of few values: nearly every group is a collision
    weak = exact_dedup.classes(docs, digest=lambda t: F.pmod(F.length(t), F.lit(3)))
    assert Counter((r["id"], r["keep"], r["size"], r["kept"], r["sha256"]) for r in weak.collect()) == brute_groups(rows)


def test_keep_one(docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows, texts = docs.select("doc_id", "text").collect(), [(r["text"] or "").translate(BLANKS) for r in kept.collect()]
    assert sorted(texts) == sorted({(r["text"] or "").translate(BLANKS) for r in rows})
    assert exact_dedup.keep_one(docs.where("false")).count() == 0 and exact_dedup.classes(docs.where("false")).count() == 0


def test_exact_dedup_runs_no_python(docs, capsys):
    exact_dedup.classes(docs).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_fim(key, text, unit="token", rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle(spark, docs, unit):
    marks = [(10_000 + i, t) for i, t in enumerate(["a <P> b", "<M>", "x<S", "<<S >", "é <　P> 漢 字🙂", "🙂" * 700 + " x", " lead", "trail \n", "<S <P <M", "a<"] * 12)]
    given = docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("f").alias("form")).unionByName(spark.createDataFrame(marks, "doc_id long, text string"), allowMissingColumns=True)
    for rate in (50, 100):
        rows = given.select("doc_id", "text").collect()
        found = fill_in_middle.fill_in_middle(given, unit=unit, rate=rate).collect()
        expected = Counter((r["doc_id"], *brute_fim(r["doc_id"], r["text"], unit, rate)) for r in rows)
        assert Counter((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found) == expected
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert Counter(r["restored_sha256"] for r in found) == Counter(sha(r["text"] or "") for r in rows)
        assert all(r["output_sha256"] == sha(r["output"]) for r in found)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(given.where("false")).count() == 0


def test_exception_index():
    text = "aé漢🙂" * 50 + "plain" + "ß"
    index = fill_in_middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    at = np.arange(len(text) + 1)
    place = np.array([len(text[:k].encode()) for k in at])
    assert (index.bytes(at) == place).all() and (index.chars(place) == at).all()
    assert len(index.at) == 151


def brute_whiten(vectors):
    x = np.vectorize(int, otypes=[object])(np.floor(1024.0 * np.array(vectors, np.float64))) + 100000
    n, total = len(x), x.sum(axis=0)
    z = n * x - total
    v = ((z.T @ z).astype(object) / n**3).astype(float)
    e, w = np.linalg.eigh(v)
    order = np.argsort(-e)
    return n, (z * z).sum(axis=1), e[order], w[:, order], (z / n).astype(float), np.trace(v)


def check_whitened(found, ids, vectors, k):
    n, far, e, w, y, trace = brute_whiten(vectors)
    by_id = defaultdict(dict)
    for r in found:
        by_id[r["id"]][r["component"]] = r
    assert sorted(by_id) == sorted(ids) and all(sorted(c) == list(range(1, k + 1)) for c in by_id.values())
    z = np.array([[by_id[i][c]["whitened"] for c in range(1, k + 1)] for i in ids])
    want = y @ w[:, :k] / np.sqrt(e[:k])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-8
    assert all(int(by_id[i][1]["deviation"]) == d and by_id[i][1]["n"] == n for i, d in zip(ids, far, strict=True))
    assert np.abs(np.array([by_id[ids[0]][c]["explained"] for c in range(1, k + 1)]) - e[:k] / trace).max() < 1e-12
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-10


@pytest.mark.parametrize(("dim", "scale"), [(64, 1.0), (5, 1.0), (9, 1e9)])
def test_whitening(spark, dim, scale):
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(300, dim)) @ rng.normal(size=(dim, dim)) + 3) * scale
    rows = [(i, v.tolist(), "w", 1) for i, v in enumerate(x)]
    bad = [(1000, None, "w", 1), (1001, [], "w", 1), (1002, [1.0, None], "w", 1), (1003, [float("nan")] * dim, "w", 1), (1004, [float("inf")] * dim, "w", 1)]
    given = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, whitened string, n int").repartition(5)
    check_whitened(whitening.whiten(given).collect(), list(range(300)), x, min(8, dim))


def test_whitening_of_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r["whitened"], r["explained"], int(r["deviation"]), r["identity_error"]) for r in one] == [(None, 0.0, 0, 0.0)] * 2
    # two lengths are fitted apart; one direction only; repeated rows and null ids count
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.0]), (7, [1e300, 0.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    flat = [r for r in found if r["id"] in (1, 2, None)]
    assert len(found) == 4 * 2 + 3 * 3 and {r["n"] for r in flat} == {4}
    assert {r["component"] for r in flat if r["whitened"] is None} == {2}
    assert Counter(round(abs(r["whitened"]), 9) for r in flat if r["component"] == 1) == {1.0: 4}


def test_jacobi_on_graded_and_deficient_matrices():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    e = 10.0 ** -np.arange(12)
    e[9:] = 0
    factor = whitening.pivoted_cholesky((q * e) @ q.T)
    values, vectors = whitening.one_sided_jacobi(factor)
    assert np.allclose(values[:9], e[:9], rtol=1e-6) and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_registered_queries(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    eleven = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in op11_exact_dedup(spark, DATA).collect())
    assert eleven == brute_groups(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    thirteen = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) for r in op13_fill_in_middle(spark, DATA).collect())
    assert thirteen == Counter((r["doc_id"], *(f := brute_fim(r["doc_id"], r["text"]))[:4], sha(f[4])) for r in docs)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    twelve = op12_embedding_whitening(spark, DATA)
    assert dict(twelve.dtypes)["deviation"] == "bigint"
    check_whitened(twelve.withColumnRenamed("vec_id", "id").collect(), [r["vec_id"] for r in vectors], [r["embedding"] for r in vectors], 8)
