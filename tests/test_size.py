"""What breaks at size and not on small tables: plans that go through the driver, work in one task, repeated keys."""

import tempfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import extract, resolve, search, store, substring
from corpusloom.plans import resolve_queries, search_queries
from corpusloom.sources.page_files import write_files
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_send_no_bodies_through_the_driver(spark):
    assert "BroadcastExchange" not in plan_of(entry.queries()["n4_probe_candidates"](spark, DATA))


def test_resolution_broadcasts_nothing(spark):
    assert "BroadcastExchange" not in plan_of(entry.queries()["n13_o3_resolution_chain"](spark, DATA))


def test_forge_origins_are_not_probed(spark):
    captured = spark.createDataFrame([(o + "/llms.txt", 200, "text/plain", "x") for o in ("https://github.com", "https://a.dev")], "url string, status int, content_type string, body string")
    origins = captured.select(F.regexp_replace("url", "/llms.txt$", "").alias("origin"))
    assert [r["origin"] for r in resolve.probe_candidates(origins, captured).collect()] == ["https://a.dev"]


def test_a_file_of_parts_is_many_tasks(spark):
    for made in (resolve_queries.bodies, resolve_queries.cands, resolve_queries.named):
        assert made(spark, DATA).rdd.getNumPartitions() >= 8


def test_a_version_after_a_join_has_one_digest(spark):
    """The join looks large and is small, so adaptive execution reads it without its shuffle."""
    pages = spark.range(4000, numPartitions=4).selectExpr("concat('t', id % 2) as technology", "string(id % 2) as version", "id as ordinal", "repeat(string(id), 2000) as content")
    wanted = spark.range(4_000_000).selectExpr("concat('t', id % 3) as technology", "string(id % 2) as version").distinct()
    rows = store.text_digests(pages.join(wanted, store.KEYS, "left_semi"), "content")
    assert "REPARTITION_BY_COL" in plan_of(rows)
    assert sorted(r["technology"] for r in rows.collect()) == ["t0", "t1"]


def test_every_capture_of_a_url_has_a_file(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    rows = spark.createDataFrame([("a.md", 2, "two"), ("a.md", 1, "one"), ("a.md", 3, "three"), ("b.md", 1, "b")], "file string, ordinal long, content string")
    write_files(rows, path, every=True)
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("_metadata.file_name", "value").collect()
    assert sorted(map(tuple, found)) == [("a.md", "one"), ("a.md", "three"), ("a.md", "two"), ("b.md", "b")]
    assert (spark.read.text(path, wholetext=True).where("_metadata.file_name = 'a.md'").first()["value"]) == "one"


def test_a_stub_lands_on_the_next_capture_of_its_target(spark):
    to = "<script>location.href = 'https://x.dev/b'</script>"
    rows = spark.createDataFrame([(1, "https://x.dev/b", 200, ""), (2, "https://x.dev/a", 200, to), (3, "https://x.dev/b", 404, ""), (4, "https://x.dev/c", 200, to), (5, "https://x.dev/b", 200, ""), (6, "https://x.dev/b", 200, ""), (7, "https://x.dev/d", 200, to), (8, "https://x.dev/e", 200, to.replace("/b", "/none"))], "id long, url string, status int, body string")
    assert sorted((r["id"], r["landed"]) for r in extract.follow_stubs(rows).collect()) == [(2, False), (4, True), (7, True), (8, False)]


def test_postings_are_cut_without_interpreted_loops(spark):
    """Words with accents, digits, stop words and repeats; a page without words has no posting."""
    pages = spark.createDataFrame([("t", "1", 1, "The Looms", "u", "Für 2 looms, LOOMS of für"), ("t", "1", 2, None, "u", " -- ")], store.PAGE_SCHEMA)
    rows = search.postings(pages)
    assert "transform(" not in plan_of(rows) and "MapInArrow" in plan_of(rows)
    found = sorted((r["term"], r["ordinal"], r["field"], r["n"], r["first"], r["words"], list(r["positions"])) for r in rows.collect())
    assert found == [("2", 1, "B", 1, 1, 6, [1]), ("=of", 1, "B", 1, 4, 6, [4]), ("=the", 1, "A", 1, 0, 6, [0]), ("für", 1, "B", 2, 0, 6, [0, 5]), ("loom", 1, "A", 1, 1, 6, [1]), ("loom", 1, "B", 2, 2, 6, [2, 3])]


def test_grams_of_a_block_come_once(spark):
    pages = spark.createDataFrame([("t", "1", 1, "ab", "c", "x𝄞y"), ("t", "1", 2, "ab", "c", "x𝄞y")], store.PAGE_SCHEMA)
    rows = substring.grams(pages)
    assert "MapInArrow" in plan_of(rows)
    assert sorted((r["gram"], r["block"]) for r in rows.collect()) == sorted((g, 0) for g in ("ab\n", "b\nc", "\nc\n", "c\nx", "\nx𝄞", "x𝄞y"))


def test_extraction_keeps_ids_beside_a_null_one(spark):
    """Ids beyond 2^53 stay whole, as no batch goes through pandas."""
    rows = spark.createDataFrame([(2**53 + 1, "u", "<p>a</p>"), (None, "v", None)], "id long, url string, body string").coalesce(1)
    found = extract.extract_pages(rows)
    assert "MapInArrow" in plan_of(found)
    assert sorted((r["url"], r["id"], r["markdown"]) for r in found.collect()) == [("u", 2**53 + 1, "a"), ("v", None, "")]


def test_a_stored_index_has_blocks_of_postings(spark):
    """A term of 50 pages of one length is one row and not 50, and the rows are those of ``postings``."""
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    rows = [("t", "1", k, f"Für {k}", "u", f" loom the w{k} loom") for k in range(50)] + [("t", "2", 1, "", "u", ""), ("t", "2", 2, None, "u", "looms über a  loom")]
    pages = spark.createDataFrame(rows, store.PAGE_SCHEMA)
    search.write_index(pages, path)
    assert spark.read.parquet(f"{path}/postings").where("term = 'loom' and version = '1'").count() == 1
    columns = ["term", *search.PAGE, "field", "n", "first", "words", "positions"]
    flat = lambda df: sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert flat(search.read_index(spark, path)) == flat(search.postings(pages))


def test_slices_are_bounded_by_bytes(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"of_title": ["a"] * 5, "of_content": ["", "x" * 30, "b", "x" * 9, "x" * 9]})
    monkeypatch.setattr(search, "BYTES_A_SLICE", 20)
    assert [s.column("of_content").to_pylist() for s in search._slices(iter([batch]))] == [[""], ["x" * 30], ["b", "x" * 9], ["x" * 9]]


def test_an_index_for_ranked_search_has_no_grams(spark):
    """Each index has the tables of its searches alone, through merges too, and a save for other searches is refused."""
    pages = spark.createDataFrame([("t", "1", 1, "a loom", "u", "the loom"), ("t", "2", 1, "b", "u", "shuttle")], store.PAGE_SCHEMA)
    for uses, tables in (((search.RANKED,), {"postings", "titles", "levels", "log"}), ((search.GRAMS,), {"grams", "log"})):
        path = tempfile.mkdtemp(prefix="spark-") + "/index"
        search.write_index(pages, path, uses)
        search.merge_index(spark, path)
        assert {f.name for f in Path(path).iterdir()} == tables
        with pytest.raises(ValueError, match="is for"):
            search.add_to_index(pages, path)
        if search.RANKED in uses:
            assert [r["title"] for r in search.search_index(spark, path, "loom").collect()] == ["a loom"]
        else:
            assert substring.candidates(search.read_grams(spark, path), "shuttle").count() == 1


def test_the_index_that_follows_saves_has_the_tables_of_its_search(spark):
    """A ranked search reads no trigrams, so no save of its index makes any."""
    path = search_queries.changed(spark, DATA)
    assert {f.name for f in Path(path.removeprefix("file:")).iterdir()} == {"postings", "titles", "levels", "log"}


def test_a_merge_deals_no_part_anew(spark):
    """Segments have the same parts: their live rows are written as they lie, in tasks of one part, and not in one task."""
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    pages = spark.createDataFrame([("t", str(k % 2), k, f"title {k}", "u", f"loom w{k} x{k}") for k in range(40)], store.PAGE_SCHEMA)
    search.write_index(pages, path, (search.RANKED,))
    merged = search._live_by_part(spark, path, "postings", 1)
    assert merged.rdd.getNumPartitions() >= search.PARTS
    assert "part" not in merged.columns and merged.count() == search._live_rows(spark, path, "postings").count()
    of_task = merged.groupBy(F.spark_partition_id()).agg(F.countDistinct(search.part_of(F.col("term"))).alias("parts"))
    assert {r["parts"] for r in of_task.collect()} == {1}
