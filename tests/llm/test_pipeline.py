"""The pipeline as a whole, and registered queries over the smallest tables, against independent versions."""

import hashlib
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import quality
from corpusloom.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.fixtures import components, documents
from tests.llm.test_documents import brute_line_dedup


def folder(docs):
    path = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_run_against_brute_force(spark):
    """Line dedup and near-dedup by brute force on what the classifier keeps; the packed ids are those of the texts."""
    docs = documents(spark, seed=3).where("doc_id is not null").dropDuplicates(["doc_id"])
    path = folder(docs)
    stored = spark.read.parquet(f"{path}/documents.parquet")
    good = quality.score(stored).where("kept").select(F.col("id").alias("doc_id")).join(stored, "doc_id").collect()
    lines = {i: t for i, (t, _) in brute_line_dedup(good).items()}
    component, _ = components(lines)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = {i: len(library.encode(lines[i], add_special_tokens=False).ids) + 1 for i, c in component.items() if i == c}
    found = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in found} == set(count)
    secret = re.compile("token|secret|password|AKIA|[0-9a-f]{24}")
    lengths = Counter()
    for r in found:
        lengths[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 2048
    assert all(lengths[i] == n for i, n in count.items() if not secret.search(lines[i]))


def test_run_on_awkward_tables(spark):
    docs = documents(spark)
    assert corpus_pipeline.run(spark, folder(docs.where("false"))).count() == 0
    assert corpus_pipeline.run(spark, folder(docs.where("text is null or text = ''"))).count() == 0
    found = corpus_pipeline.run(spark, folder(docs))  # null ids, repeated rows, clashing columns
    assert found.where("doc_id is not null").select("doc_id", "start").distinct().count() == found.where("doc_id is not null").count()


def table(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, DATA).collect()}


def test_registered_secret_scan(spark):
    found, given = rows(spark, "op1_secret_scan"), table(spark)
    assert set(found) == set(given)
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, r in found.items():
        t = given[i]["text"] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("opaque")] == names


def test_registered_near_duplicates(spark):
    found, given = rows(spark, "op6_hyperminhash"), table(spark)
    component, size = components({i: r["text"] for i, r in given.items()})
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (size[i], component[i], component[i] == i) for i in given}


def test_registered_quality(spark):
    """Votes, expectation-maximisation and decisions: junk by the given labels goes, the rest stays."""
    found = rows(spark, "op4_quality_classifier")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert np.mean([found[i]["kept"] == bool(q) for i, q in labels.items()]) > 0.97
    assert all(r["kept"] == (r["quality"] >= 0.5) and 0 <= r["weak_label"] <= 1 for r in found.values())


def test_registered_languages(spark):
    found, given = rows(spark, "op5_language_id"), table(spark)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    known = [i for i in found if found[i]["held_out"] and given[i]["lang"] and any(c.isalpha() for c in given[i]["text"] or "")]
    assert np.mean([found[i]["lang_pred"] == given[i]["lang"] for i in known]) > 0.95


def test_registered_codec_and_media(spark):
    given, library = table(spark), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows(spark, "op10_bpe_codec").items():
        ids = library.encode(given[i]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for i, r in rows(spark, "op7_media_columns").items():
        raw = (given[i]["text"] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()


def test_registered_packing(spark):
    given, library = table(spark), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for i, r in given.items()}
    covered, used = {i: np.zeros(len(x), int) for i, x in ids.items()}, {}
    for r in QUERIES["op9_packing"](spark, DATA).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (zlib.crc32(part.tobytes()), len(ids[r["doc_id"]])) == (r["ids_crc32"], r["doc_tokens"])
        covered[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((c == 1).all() for c in covered.values())
    for parts in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0
    filled = sum(n for parts in used.values() for _, n in parts)
    assert filled / (2048 * len(used)) > 0.95
