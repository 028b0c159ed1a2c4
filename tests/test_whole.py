"""Whole jobs: every row takes part, and no group grows with a hot key."""

import tempfile

from pyspark.sql import functions as F

from corpusloom.operators import store
from corpusloom.plans import capture_queries, crawl_queries, store_queries
from corpusloom.session import number_rows
from corpusloom.sources import captures as scans
from tests.conftest import DATA


def test_number_rows_across_partitions(spark):
    rows = [(None, i % 3) for i in range(300)] + [("a", 7)] * 200 + [("b", None), ("b", 1)]
    given = spark.createDataFrame(rows, "k string, x long").repartition(5)
    found = number_rows(given, ["k"], [F.col("x")]).collect()
    for key in (None, "a", "b"):
        mine = sorted((r["number"], r["x"]) for r in found if r["k"] == key)
        assert [n for n, _ in mine] == list(range(sum(k == key for k, _ in rows)))
        xs = [x for _, x in mine]
        assert xs == sorted(xs, key=lambda x: (x is not None, x or 0))
    # long texts with one head stay in order across partitions
    texts = ["x" * n for n in range(50, 250)] + [None, ""]
    long = spark.createDataFrame([(1, t) for t in texts], "k long, t string").repartition(4)
    ordered = [r["t"] for r in sorted(number_rows(long, ["k"], [], "t").collect(), key=lambda r: r["number"])]
    assert ordered == [None, "", *texts[:-2]]
    places = sorted(r["number"] for r in number_rows(given, [], [F.desc("x")]).collect())
    assert places == list(range(len(rows)))


def test_dumps_hold_all_documents_of_a_source(spark):
    rows = [(i, f"hot {i} " + "word " * 60, "hot") for i in range(4500)] + [(8, "a small one", "small"), (None, "no id", "small")]
    found = capture_queries.whole_dumps(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    titles = [r["title"] for r in found if r["source"] == "hot"]
    # more than 4,000 documents: one dump would have stayed whole
    assert sorted(t for t in titles if t != "A preamble") == sorted(f"doc {i}" for i in range(4500))
    assert titles.count("A preamble") == 18
    assert [(r["dump"], r["title"]) for r in found if r["source"] == "small"] == [(0, "A preamble")]


def test_combined_blocks(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/blocks"
    rows = [("t", "1", 9, "a", "u", "ends in a line\n"), ("t", "1", 2, "", "v", "x\n\n---\n\n## inner\n\nSource: <w>\n\ny"), ("t", "2", 1, "c", "u", "")]
    rows += [("hot", "1", i, f"p{i}", "u", "body " * 20) for i in range(400)]
    pages = spark.createDataFrame(rows, store.PAGE_SCHEMA).repartition(3)
    whole = store.combined(pages).select("technology", "version", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, store.combined_digests(pages).collect())) == sorted(map(tuple, whole))
    blocks = store.combined_blocks(pages)
    store.save_blocks(blocks, path, 4)
    # a large version lies in more than one file
    assert spark.read.parquet(path).where("technology = 'hot'").select(F.input_file_name()).distinct().count() > 1
    expected = [(*r[:2], {9: 2, 2: 1}[r[2]] if r[:2] == ("t", "1") else r[2] + (r[0] == "hot"), *r[3:]) for r in rows]
    assert sorted(map(tuple, store.split_blocks(spark.read.parquet(path)).select(*pages.columns).collect())) == sorted(expected)


def test_no_version_is_collected(spark):
    # the plans of export, split, backfill and read have no collected list
    for name in ("k4_combined_export", "s9_split_combined", "k7_backfill", "r1_read_version"):
        plan = store_queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan, name


def test_whole_queries_leave_no_row_out(spark):
    documents, pages = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("documents", "pages"))
    bundles = capture_queries.QUERIES["x18_bundle"](spark, DATA)
    assert bundles.agg(F.sum("documents")).first()[0] == documents
    assert {r[0] for r in bundles.select("documents").distinct().collect()} == {1, 2, 3}
    assert capture_queries.QUERIES["j5_capture_lookup"](spark, DATA).select("asked").distinct().count() == pages
    versions = store_queries.QUERIES["j1_versions_with_pages"](spark, DATA).collect()
    assert sum(r["pages"] for r in versions) == documents
    assert {r["version"] for r in versions if r["pages"] == 0} == {"unreleased"}


def test_caps_and_no_cap(spark):
    tree = spark.createDataFrame([("r", i, f"docs/p{i}.md") for i in range(300)] + [("s", 1, "README.md")], "repo string, pos long, path string")
    for cap, expected in ((5, 6), (200, 201), (0, 301)):
        assert scans.repository_files(tree, cap).count() == expected
    found = crawl_queries.QUERIES["c2_crawl_statistics_harvest"](spark, DATA).collect()
    assert found and all(r["remaining"] == 0 and not r["truncated"] and r["fetched"] == r["discovered"] for r in found)


def test_labels_are_ordered_in_partitions(spark):
    plan = store_queries.QUERIES["v2_v3_ordered_labels"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # the only window is over the counts of partitions
    assert "row_number" not in plan
