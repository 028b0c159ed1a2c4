"""Documentation files, files of pages, declared charsets, pages asked for: by hand."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import store
from corpusloom.sources import captures, page_files

AT = datetime.datetime(2026, 8, 20, 9, 5)


def pages_of(spark):
    rows = [
        ("t", "1", 4, "Alpha", "https://t.example.dev/a", "<!-- source: x | y -->\n\n\n  alpha\n\n---\n\nbody \n"),
        ("t", "1", 9, "Beta", "https://t.example.dev/b", "beta"),
        ("u", "2", 1, "One", "https://u.example.dev/", "only"),
    ]
    versions = [("t", "1", "https://t.example.dev/docs", "sitemap", AT), ("u", "2", "no address", None, None), ("v", "3", "https://v.example.dev", "html", AT)]
    return spark.createDataFrame(rows, store.PAGE_SCHEMA), spark.createDataFrame(versions, "technology string, version string, source string, strategy string, harvested_at timestamp")


FILE = """# t.example.dev documentation

<!-- harvested: 2 pages | from: https://t.example.dev/docs | via: sitemap | 2026-08-20 09:05 -->

## Contents

1. [Alpha](https://t.example.dev/a)
2. [Beta](https://t.example.dev/b)


---

## Alpha

Source: <https://t.example.dev/a>

alpha

---

body


---

## Beta

Source: <https://t.example.dev/b>

beta
"""


def test_documentation_file(spark):
    pages, versions = pages_of(spark)
    pieces = store.file_pieces(pages, versions).orderBy("technology", "version", "ordinal").collect()
    texts = {t: "".join(p.piece for p in pieces if p.technology == t) for t in "tuv"}
    assert texts["t"] == FILE and texts["v"] == ""
    assert texts["u"].startswith("# no address documentation\n\n<!-- harvested: 1 pages | from: no address | via:  |  -->\n")
    whole = spark.createDataFrame([("t", "1", FILE)], "technology string, version string, text string")
    assert [(p.ordinal, p.title, p.content) for p in store.split_combined(whole).orderBy("ordinal").collect()] == [(1, "Alpha", "alpha\n\n---\n\nbody"), (2, "Beta", "beta")]


def test_pages_asked_for(spark):
    pages, _ = pages_of(spark)
    asked = spark.createDataFrame([("t", "1", 4), ("t", "1", 5), ("w", "1", 1)], "technology string, version string, ordinal long")
    found = {(r.technology, r.ordinal): (r.found, r.reason, r.title) for r in store.pages_by_ordinal(pages, asked).collect()}
    assert found == {("t", 4): (True, None, "Alpha"), ("t", 5): (False, "t has no page 5", None), ("w", 1): (False, "w has no page 1", None)}


def test_declared_charsets(spark):
    said = "Ünï – 日本"
    cases = [
        ("text/html; charset=utf-16", said.encode("utf-16"), said),
        ("text/html; Charset='euc-jp'", "日本".encode("euc-jp"), "日本"),
        ("text/html; charset=us-ascii", b"a\xe9b", "a�b"),
        ("text/html; charset=latin1", b"a\xe9b", "aéb"),
        ("text/html; charset=idna", b"a\xe9b", "a�b"),
        ("text/html; charset=base64", b"abc", "abc"),
        ("text/html", b"a\xff", "a�"),
        (None, said.encode(), said),
        ("text/html; charset=shift_jis", None, None),
        ("text/html; charset=shift_jis", b"", ""),
    ]
    rows = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(cases)], "id int, content_type string, body binary")
    assert [r.body for r in captures.decoded(rows).orderBy("id").collect()] == [want for _, _, want in cases]


def files_in(path):
    return {name: open(f"{path}/{name}", encoding="utf-8").read() for name in os.listdir(path)}


def some_files(spark):
    return spark.createDataFrame([("a.md", 2, "two"), ("a.md", 1, "one"), ("b.md", 1, None), ("c.md", 1, "é")], "file string, ordinal int, content string")


def test_files_of_pages(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    page_files.write_files(some_files(spark), f"{folder}/out", root=folder)
    assert files_in(f"{folder}/out") == {"a.md": "two", "b.md": "", "c.md": "é"}
    with pytest.raises(Exception, match="exists already"):
        page_files.write_files(some_files(spark), f"{folder}/out")
    page_files.write_files(some_files(spark).where("file = 'a.md'"), f"{folder}/out", joined=True, overwrite=True)
    assert files_in(f"{folder}/out") == {"a.md": "one\n\n---\n\ntwo"}
    page_files.write_files(some_files(spark).limit(0), f"{folder}/none")
    assert os.listdir(folder) and files_in(f"{folder}/none") == {}


def test_a_failed_write_leaves_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for bad in ("../x.md", "", ".."):
        with pytest.raises(Exception, match="not a file name"):
            page_files.write_files(some_files(spark).withColumn("file", F.when(F.col("file") == "c.md", bad).otherwise(F.col("file"))), f"{folder}/out")
    with pytest.raises(Exception, match="outside"):
        page_files.write_files(some_files(spark), f"{folder}/in/../out", root=f"{folder}/in")
    assert os.listdir(folder) == []


def test_manifests_are_read_whole(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    bodies = {"go.mod": "module a\n\nrequire b v1\n", "app/package.json": '{\n "name": "a"\n}\n', "app/node_modules/x/package.json": "{}", "a/b/c/d/go.mod": "deep", "notes.txt": "no"}
    for name, body in bodies.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
            out.write(body)
    found = {r.path: r.body for r in captures.read_manifests(spark, folder).collect()}
    assert found == {name: bodies[name] for name in ("go.mod", "app/package.json")}


def test_a_large_version_has_several_files(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/store"
    n = 1000
    rows = spark.range(n).select(F.lit("t").alias("technology"), F.when(F.col("id") % 10 == 0, "2").otherwise("1").alias("version"), (n * 3 - F.col("id") * 3).alias("ordinal"), F.lit("x").alias("title"), F.col("id").cast("string").alias("url"), F.lit("é").alias("content"))
    store.save(rows, path, pages_a_file=200)
    saved = spark.read.schema(f"{store.PAGE_SCHEMA}, characters long").parquet(path)
    files = saved.groupBy("version", F.col("_metadata.file_name").alias("f")).agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count("*").alias("n")).collect()
    # each file holds one range of 200 ordinals, and together they are 1 to n
    assert sorted((f.version, f.a, f.b, f.n) for f in files) == [("1", 1, 200, 200), ("1", 201, 400, 200), ("1", 401, 600, 200), ("1", 601, 800, 200), ("1", 801, 900, 100), ("2", 1, 100, 100)]
    assert [r.url for r in saved.where("version = '2'").orderBy("ordinal").collect()] == [str(i) for i in range(990, -1, -10)]
    # saved again, shorter: nothing of the old version stays
    store.save(rows.where("version = '1' and ordinal < 100"), path)
    again = spark.read.schema(f"{store.PAGE_SCHEMA}, characters long").parquet(path)
    assert again.groupBy("version").count().orderBy("version").collect() == [("1", 30), ("2", 100)]


def test_versions_without_a_name(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/store"
    rows = spark.createDataFrame([(None, "1", 7, "a", "u", "x"), ("t", None, 7, "b", None, None), ("t", "", 8, "c", "v", "y")], store.PAGE_SCHEMA)
    store.save(rows, path)
    saved = spark.read.schema(f"{store.PAGE_SCHEMA}, characters long").parquet(path)
    assert sorted((r.title, r.technology, r.version, r.ordinal, r.characters) for r in saved.collect()) == [("a", None, "1", 1, 1), ("b", "t", None, 1, None), ("c", "t", None, 1, 1)]
