"""Operators on small fixtures: sinks, extraction, crawl, resolution, dependencies, streaming."""

import math
import re
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from corpusloom.operators import chat, crawl, deps, extract, resolve, search, store, substring
from corpusloom.operators.parts import of_keys
from corpusloom.streaming.ingest import ingest, pages_of

PAGE = store.PAGE_SCHEMA


def test_save_replaces_only_its_versions(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/store"
    old = spark.createDataFrame([("t", "2.10", 1, "a", "u", "old"), ("t", "v2", 1, "b", "u", "two")], PAGE)
    store.save(old, path)
    store.save(spark.createDataFrame([("t", "2.10", 1, "a", "u", "new")], PAGE), path)
    rows = {(r["version"], r["content"]) for r in spark.read.schema(PAGE).parquet(path).collect()}
    assert rows == {("2.10", "new"), ("v2", "two")}


def test_completeness_is_three_valued(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", None), ("b", True), ("c", True)], "k string, complete boolean")
    found = {r["k"]: r["c"] for r in rows.groupBy("k").agg(store.merged_complete(F.col("complete")).alias("c")).collect()}
    assert found == {"a": False, "b": None, "c": True}


def test_combined_text_splits_back(spark):
    pages = spark.createDataFrame([("t", "1", i, f"Title {i}", f"https://x.dev/{i}", f"line\n## inner {i}\nend") for i in range(1, 4)], PAGE)
    assert sorted(map(tuple, store.split_combined(store.combined(pages)).select(*pages.columns).collect())) == sorted(map(tuple, pages.collect()))


def test_page_extraction():
    html = "<html><head><title>T</title></head><body><nav><a href='/x'>nav</a></nav><main><h1>Head</h1><p>" + "word " * 60 + "<ul><li>one<li>two</ul></main><footer>foot</footer></body></html>"
    title, body = extract.page_of(html)
    assert title == "T" and body.startswith("# Head") and "- one" in body and "nav" not in body and "foot" not in body
    assert extract.page_of("") == ("Untitled", "")


def test_page_extraction_keeps_structure():
    html = """<main><h2>Looms</h2><p>Use <code>weave()</code> and <a href="/warp">the <b>warp</b></a>.</p>
    <ul><li>one<ul><li>inner</li></ul></li><li><em>two</em></ul><ol><li>first<li>second</ol>
    <table><tr><th>name<th>size</tr><tr><td>shed<td><p>big</p></td></tr></table><pre>if x:
    y()</pre></main>"""
    _, body = extract.page_of(html + "<main>" + "word " * 60 + "</main>")
    for part in ("## Looms", "Use `weave()` and [the **warp**](/warp).", "- one\n  - inner\n- *two*", "1. first\n2. second", "| name | size |\n| --- | --- |\n| shed |", "```\nif x:\n    y()\n```"):
        assert part in body, (part, body)


def test_stubs_by_script_and_meta(spark):
    bodies = ["<script>window.location.replace('/b')</script>", "<script>location.href = \"/b\"</script>", "<meta content='0;URL=/b' http-equiv=refresh>", "<p>no stub</p>"]
    rows = spark.createDataFrame([(i, f"https://x.dev/a{i}", 200, b) for i, b in enumerate(bodies)], "id long, url string, status int, body string")
    assert sorted((r["id"], r["target"]) for r in extract.follow_stubs(rows).collect()) == [(i, "https://x.dev/b") for i in range(3)]


def test_crawl_of_captures_skips_failed_pages(spark):
    to = lambda *paths: "".join(f"<a href='{p}'>x</a>" for p in paths)
    rows = [
        (1, "https://x.dev/docs/", 200, "text/html", to("/docs/a", "/docs/gone", "/docs/b.png", "https://else.dev/docs/q")),
        (2, "https://x.dev/docs/a", 200, "text/html", to("/docs/", "#top", "/docs/missing", "/docs/c/")),
        (3, "https://x.dev/docs/gone", 500, "text/html", to("/docs/behind")),
        (4, "https://x.dev/docs/behind", 200, "text/html", ""),
        (5, "https://x.dev/docs/c", 200, "image/png", to("/docs/behind")),
    ]
    captured = spark.createDataFrame(rows, "id long, url string, status int, content_type string, body string")
    start = spark.createDataFrame([("x", "https://x.dev/docs", "x.dev", "/docs/")], "site string, url string, host string, prefix string")
    found = {r["url"].rpartition("/docs")[2]: (r["depth"], r["fetched"]) for r in crawl.crawl_captures(start, captured).collect()}
    assert found == {"": (0, True), "/a": (1, True), "/gone": (1, False), "/missing": (2, False), "/c": (2, False)}


def test_resolution_chain_by_hand(spark):
    page = "<p>" + "word " * 60 + "</p><pre>x</pre><pre>y</pre><code>z</code> "
    web = [("https://loomkit.io", page + "pip install loomkit"), ("https://loomkit.io/docs/", page + "loomkit " * 4), ("https://spindle.example.net/", page + "npm install spindle")]
    captured = spark.createDataFrame([(u, 200, "text/html", u, b) for u, b in web], "url string, status int, content_type string, landed string, body string")
    wanted = spark.createDataFrame([("loomkit", ""), ("spindle", ""), ("nobody", "")], "name string, hint string")
    declared = spark.createDataFrame([("spindle", "npm", 0, "npm:homepage", "homepage", "https://spindle.example.net/"), ("loomkit", "npm", 0, "npm:homepage", "homepage", "https://other.example.com/")], "name string, ecosystem string, pos int, source string, field string, url string")
    found = {r["name"]: (r["best"], r["via"], r["ecosystem"], r["candidates"]) for r in resolve.resolve_names(wanted, declared, captured).collect()}
    # the documentation under an own domain stands before the domain itself, and no registry is asked then
    assert found == {"loomkit": ("https://loomkit.io/docs/", "domain", "", 2), "spindle": ("https://spindle.example.net/", "registry", "npm", 1), "nobody": (None, "unresolved", "", 0)}


def test_resolution_looks_at_every_candidate(spark):
    """The only verified candidate of nine has the least confidence; the chain finds the page behind eight others too."""
    rows = [("loom", f"https://c{k}.example.com/loom", f"npm:{k}", 0.9 - k / 10, k == 8) for k in range(9)]
    given = spark.createDataFrame(rows, "name string, url string, source string, confidence double, verified boolean")
    assert tuple(resolve.resolve(given.limit(0), given).first()) == ("loom", "https://c8.example.com/loom", "registry", 9)
    assert resolve.top_candidates(given).count() == 6 and resolve.resolve(given.limit(0), given, 6).first()["best"] is None

    page = "<p>" + "word " * 60 + "</p><pre>x</pre><pre>y</pre><code>z</code> npm install loom"
    captured = spark.createDataFrame([("https://z.example.net/book", 200, "text/html", "https://z.example.net/book", page)], "url string, status int, content_type string, landed string, body string")
    urls = [f"https://docs{k}.example.com/docs/" for k in range(8)] + ["https://z.example.net/book"]
    declared = spark.createDataFrame([("loom", "npm", k, f"npm:{k}", "documentation" if k < 8 else "homepage", u) for k, u in enumerate(urls)], "name string, ecosystem string, pos int, source string, field string, url string")
    declared = declared.union(declared.where("pos = 8").selectExpr("name", "ecosystem", "9", "'npm:homepage'", "field", "url"))
    found = resolve.resolve_names(spark.createDataFrame([("loom", "")], "name string, hint string"), declared, captured).first()
    assert (found["best"], found["via"], found["candidates"]) == ("https://z.example.net/book", "registry", 9)


def test_dump_split_keeps_every_word(spark):
    body = "<h1>Banner</h1>\n" + "\n".join(f"## s{i}\ntext {i}" for i in range(10))
    rows = extract.split_dumps(spark.createDataFrame([("s", body)], "source string, text string"), 10).orderBy("part").collect()
    assert len(rows) == 11 and "<" not in rows[0]["title"]
    assert " ".join(r["markdown"] for r in rows).split() == body.split()
    assert extract.split_dumps(spark.createDataFrame([("s", body)], "source string, text string")).count() == 1


def test_crawl_cap_and_remaining(spark):
    pages = ["https://x.dev/docs/"] + [f"https://x.dev/docs/p{i}" for i in range(6)]
    links = spark.createDataFrame([(a, b) for a in pages for b in pages], "src string, dst string")
    start = spark.createDataFrame([("s", pages[0], "x.dev", "/docs/")], "site string, url string, host string, prefix string")
    reached = crawl.reachable(start, links)
    assert reached.count() == 7
    assert tuple(crawl.statistics(reached, links, crawl.capped(reached, ["url"], 3)).first()) == ("s", 3, 4, 7, True)
    assert tuple(crawl.statistics(reached, links, crawl.capped(reached, ["url"], 0)).first()) == ("s", 7, 0, 7, False)


def verdict(spark, name, url, body, ecosystem="", repository="", homepage="", via=False):
    row = spark.createDataFrame([(name, url, body, ecosystem, repository, homepage, via)], "name string, url string, body string, ecosystem string, repository string, homepage string, via_domain boolean")
    r = resolve.signals(row).first()
    return r["signals"], r["verified"]


def test_identity(spark):
    body = "treadle " * 30
    assert verdict(spark, "treadle", "https://elsewhere.com/", body) == (["names-it:30"], False)
    assert verdict(spark, "treadle", "https://treadle.website/", "treadle " * 5)[1] is True
    assert verdict(spark, "treadle", "https://github.com/weaver/treadle", body)[1] is False  # a forge's page is not its home
    assert verdict(spark, "treadle", "https://elsewhere.com/", "npm install treadle, treadle, treadle", "npm") == (["install:npm", "names-it:3"], True)
    assert verdict(spark, "treadle", "https://elsewhere.com/", "cargo add treadle, treadle, treadle", "npm")[1] is False  # another ecosystem
    assert verdict(spark, "bobbin", "https://docs.bobbin.build/", "") == (["own-domain", "docs-host"], True)


def test_alias(spark):
    have = spark.createDataFrame([("treadle",), ("spool",), ("spool-rack",)], "technology string")
    asked = spark.createDataFrame([("Treadle.js",), ("TREADLE",), ("tread",), ("spo",), ("spool",), ("knot",)], "asked string")
    found = {r["asked"]: r["technology"] for r in resolve.alias(asked, have).collect()}
    assert found == {"Treadle.js": "treadle", "TREADLE": "treadle", "tread": "treadle", "spo": None, "spool": "spool", "knot": None}


def test_toml_and_inventory(spark):
    assert deps.toml_dependencies("= broken") == []
    assert ("x", "1.2") in deps.toml_dependencies('[dependencies]\nx = {version = "1.2"}')
    assert "python" not in dict(deps.toml_dependencies('[tool.poetry.dependencies]\npython = "^3"\ny = "*"'))
    rows = spark.createDataFrame([("p", 1, "a", "", "npm"), ("p", 2, "a", "^2", "pypi"), ("p", 3, "b", "", "npm")], "project string, pos long, name string, spec string, ecosystem string")
    assert {tuple(r) for r in deps.inventory(rows).collect()} == {("p", "a", "^2", "pypi"), ("p", "b", "", "npm")}


def test_search(spark):
    pages = spark.createDataFrame([("t", "1", 1, "Retry policy", "u", "use a retry with a backoff"), ("t", "1", 2, "Other", "u", "retry only")], PAGE)
    index = search.postings(pages)
    assert [r["ordinal"] for r in search.ranked(index, pages, "retry backoff").collect()] == [1]
    assert [r["ordinal"] for r in search.ranked(index, pages, "retry").collect()] == [1, 2]
    assert [r["ordinal"] for r in search.ranked(index, pages, "retry -backoff").collect()] == [2]
    assert search.ranked(index, pages, "  ").count() == 0
    # words that repeat, words of other scripts, stop words alone, scopes
    assert [r["ordinal"] for r in search.ranked(index, pages, 'retry retry "retry with" retry').collect()] == [1]
    assert [r["ordinal"] for r in search.ranked(index, pages, '"with a"').collect()] == [1]
    other = spark.createDataFrame([("t", "1", 1, "Été", "u", "l'été à la plage"), ("t", "2", 2, "Straße", "u", "don't été"), ("u", "1", 3, "t", "u", "t")], PAGE)
    found = lambda q, **kw: [(r["technology"], r["version"]) for r in search.ranked(search.postings(other), other, q, **kw).collect()]
    assert found("été") == [("t", "1"), ("t", "2")] and found("straße") == [("t", "2")] and found("t") == [("u", "1"), ("t", "2")]
    assert found("été", version="2") == [("t", "2")] and found("été", technology="u") == []
    hit = search.headline(search.ranked(index, pages, "backoff"), pages, "backoff").first()["headline"]
    assert "«backoff»" in hit


def test_history_takes_the_window_first(spark):
    rows = spark.createDataFrame([(1, t, "system" if t > 38 else "user", f"m{t}") for t in range(45)], "conv_id long, turn long, role string, text string")
    assert chat.history(rows).count() == 34


def test_search_over_a_stored_index(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    pages = spark.createDataFrame([("t", "1", i, f"page {i}", "u", f"word{i} common") for i in range(30)], PAGE)
    search.write_index(pages, path)
    stored = search.read_index(spark, path)
    found = search.search_index(spark, path, "word7 common")
    assert [(r["ordinal"], r["title"]) for r in found.collect()] == [(7, "page 7")]
    of_term = of_keys(stored, ["word7"])
    plan = of_term._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,word7\)", plan)


def brute_search(pages, has, score_terms):
    """Pages that ``has`` admits, by the documented score."""
    word = lambda t: [search.stem_word(w) for w in re.findall(r"[^\W_]+", t.lower())]
    out = []
    for tech, version, ordinal, title, _, content in pages:
        a, b = word(title), word(content)
        if has(a, b):
            weight = sum(min(3, a.count(t)) + 0.4 * min(10, b.count(t)) for t in score_terms)
            out.append((-round(weight / (1 + math.log(1 + len(b))), 6), tech, version, ordinal))
    return [r[1:] for r in sorted(out)]


def test_query_tree_and_phrases_by_position(spark):
    texts = ["retry policies apply", "policy retry", "the retried policy of a retry", "backoff only", "retrying: the policy", "policy", "retry, policy and backoff"]
    pages = [("t", "1", k, f"title {k}" if k else "Retry policy", "u", t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(pages, PAGE)
    index = search.postings(frame).cache()
    found = lambda q: [(r["technology"], r["version"], r["ordinal"]) for r in search.ranked(index, frame, q, 100).collect()]

    def near(words, *terms):
        return any(words[i : i + len(terms)] == list(terms) for i in range(len(words)))

    both = lambda *p: (lambda a, b: near(a, *p) or near(b, *p))
    phrase = both("retry", "policy")
    assert found('"retry policy"') == brute_search(pages, phrase, ["retry", "policy"])
    assert found('policy -"retry policy"') == brute_search(pages, lambda a, b: "policy" in a + b and not phrase(a, b), ["policy"])
    assert found('"retry policy" or backoff') == brute_search(pages, lambda a, b: phrase(a, b) or "backoff" in b, ["retry", "policy", "backoff"])
    assert found('"retry the policy"') == found('"retrying the policy"') == [("t", "1", 4)]
    assert found('backoff or "policy retry" -only') == brute_search(pages, lambda a, b: ("backoff" in b or near(b, "policy", "retry")) and "only" not in b, ["backoff", "policy", "retry"])
    assert found('-"retry policy"') == [] and found('"" -') == [] and found('"the"') == [("t", "1", 2), ("t", "1", 4)]


def test_index_follows_the_store(spark):
    """Save, replace, delete, merge and ingest; each time the search equals one over a rebuilt index."""
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    rows = lambda *vs: [(t, v, k, f"title {t} {v}", "u", f"loom word{k} {'x ' * k}{note}") for t, v, n, note in vs for k in range(1, n + 1)]
    frame = lambda given: spark.createDataFrame(given, PAGE)

    def same(now):
        for query in ("loom", '"loom word2"', "loom -changed", "title changed"):
            mine = search.search_index(spark, path, query, 100).collect()
            assert mine == search.ranked(search.postings(frame(now)), frame(now), query, 100).collect()

    first = rows(("a", "1", 3, "old"), ("a", "2", 2, "old"), ("b", "1", 2, "old"))
    search.add_to_index(frame(first), path)
    same(first)
    changed = rows(("a", "2", 4, "changed"))
    search.add_to_index(frame(changed), path)
    now = [r for r in first if r[:2] != ("a", "2")] + changed
    same(now)
    search.drop_from_index(spark.createDataFrame([("b", None), ("a", "9")], "technology string, version string"), path)
    now = [r for r in now if r[0] != "b"]
    same(now)
    search.merge_index(spark, path)
    same(now)
    assert {f.name for f in Path(f"{path}/postings").iterdir() if f.is_dir()} == {f"segment={search.live(spark, path).first()['segment']}"}
    again = rows(("b", "1", 2, "changed"))
    search.add_to_index(frame(again), path)
    same(now + again)


def test_search_stops_early_with_the_same_pages(spark):
    """Bands by best possible score: whatever a round reads, the rows are those of reading all."""
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    length = lambda k: 1 + (k * k) % 400
    rows = [("t", str(k % 3), k, "loom" if k % 40 == 0 else "title", "u", f"{'loom ' * (k % 5)}{'x ' * length(k)}{'shuttle warp' if k % 7 == 0 else ''}") for k in range(240)]
    pages = spark.createDataFrame(rows, PAGE)
    search.write_index(pages, path)
    index = search.postings(pages).cache()
    for query in ("loom", "loom shuttle", "loom -shuttle", '"shuttle warp" or title', "absent loom", '"the loom"', "-loom", ""):
        whole = search.ranked(index, pages, query, 5).collect()
        for rows_a_round in (1, 40, 10**6):
            assert search.search_index(spark, path, query, 5, rows_a_round=rows_a_round).collect() == whole, (query, rows_a_round)
    scoped = search.search_index(spark, path, "loom", 100, version="1", rows_a_round=1).collect()
    assert scoped == search.ranked(index, pages, "loom", 100, version="1").collect() and len(scoped) > 50
    best, read, total = search.best_pages(search.read_index(spark, path).where("term = 'loom'"), search.read_levels(spark, path), search.parse("loom"), 5, 1)
    assert len(best) == 5 and read < total / 4


def test_substring_search_reads_candidate_blocks(spark):
    """The rows of the plain search, for phrases at block borders, short ones, other scripts, and nulls."""
    words = ["Loom", "shuttle", "für\nWärme", "😀😀x", "a%b_c"]
    rows = [(f"t{k % 2}", "1" if k % 3 else "2", k, None if k % 11 == 0 else f"Title {k}", f"u/{k}", None if k % 13 == 0 else f"{words[k // 90 % 5]} {k} end") for k in range(450)]
    rows += [(None, "1", 7, "Loom", "u", "no technology"), ("t0", None, 7, "Loom", "u", "no version"), ("t0", "1", None, "Loom", "u", "no number")]
    pages = spark.createDataFrame(rows, PAGE)
    grams = substring.grams(pages).cache()
    assert {(r["technology"], r["version"], r["block"]) for r in substring.candidates(grams, "SHUTTLE").collect()} == {(t, v, b) for t in ("t0", "t1") for v in "12" for b in (0, 1)}
    assert substring.candidates(grams, "loomshuttle").count() == 0
    for phrase in ("loom", "SHUTTLE 9", "r\nw", "😀x", "%b_", "no ", "lo", "", "absent phrase", "e 17"):
        for limit in (1, 60):
            plain = store.substring_search(pages, phrase, limit).collect()
            for first in (1, 100):
                assert substring.search(pages, grams, phrase, limit, first).collect() == plain, (phrase, limit, first)
    assert substring.search(pages.limit(0), grams.limit(0), "loom", 5).count() == 0


def test_ingest_keeps_the_index_in_step(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for batch in ([(1, 1, "old loom", "2031-02-03"), (2, 2, "loom", "2031-02-03")], [(3, 1, "new shuttle", "2031-02-04")]):
        captured(spark, batch).write.mode("append").parquet(f"{root}/in")
        ingest(spark, f"{root}/in", f"{root}/store", f"{root}/state", f"{root}/index").awaitTermination()
        pages = spark.read.schema(PAGE).parquet(f"{root}/store")
        for query in ("loom", "shuttle"):
            mine = search.search_index(spark, f"{root}/index", query).collect()
            assert mine == search.ranked(search.postings(pages), pages, query).collect()


def test_saved_store_is_numbered_and_pruned(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/store"
    store.save(spark.createDataFrame([("t", "1", k, "a", f"u{k}", "x" * k) for k in (40, 7, 19)] + [("s", "2", 5, "b", "u", "yy")], PAGE), path)
    saved = spark.read.schema(f"{PAGE}, characters long").parquet(path)
    assert sorted((r["ordinal"], r["url"], r["characters"]) for r in saved.where("technology = 't'").collect()) == [(1, "u7", 7), (2, "u19", 19), (3, "u40", 40)]
    plan = store.page_sizes(saved.where("technology = 't'"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(technology" in plan and "ReadSchema: struct<characters:bigint>" in plan


def test_deep_crawl_ends(spark):
    chain = [f"https://x.dev/docs/p{i}" for i in range(24)]
    links = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "src string, dst string")
    start = spark.createDataFrame([("s", chain[0], "x.dev", "/docs/")], "site string, url string, host string, prefix string")
    assert sorted(r["depth"] for r in crawl.reachable(start, links).collect()) == list(range(24))


def captured(spark, rows):
    made = [(i, f"https://loom.dev/v1/p{p}", 200, "text/html", f"<title>t{p}</title><p>{body}", when) for i, p, body, when in rows]
    return spark.createDataFrame(made, "id long, url string, status int, content_type string, body string, harvested_at string").withColumn("harvested_at", F.col("harvested_at").cast("timestamp"))


def test_streaming_ingest_merges_batches_of_one_version(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    batches = [[(i, i, f"old {i}", "2031-02-03") for i in range(4)], [(9, 1, "new 1", "2031-02-04"), (10, 7, "more", "2031-02-04")], [(11, 2, "stale", "2031-01-01")]]
    for batch in batches:
        captured(spark, batch).write.mode("append").parquet(f"{root}/in")
        ingest(spark, f"{root}/in", f"{root}/store", f"{root}/state").awaitTermination()
    # of each URL the newest capture, in the order of ids
    newest = {}
    for i, p, body, when in (row for batch in batches for row in batch):
        newest[p] = max(newest.get(p, ("", 0, "")), (when, i, body))
    expected = [(k + 1, f"https://loom.dev/v1/p{p}", body) for k, (p, (_, _, body)) in enumerate(sorted(newest.items(), key=lambda x: x[1][1]))]
    rows = spark.read.schema(PAGE).parquet(f"{root}/store").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["url"], r["content"]) for r in rows] == expected
    # rows that share an id are pages of their own, each once
    shared = captured(spark, [(1, 1, "a", "2031-02-03"), (1, 2, "b", "2031-02-04"), (None, 3, "c", "2031-02-03"), (None, 4, "d", None)])
    found = [(r["url"][-2:], r["content"], r["harvested_at"] and r["harvested_at"].strftime("%d")) for r in pages_of(shared).collect()]
    assert sorted(found) == [("p1", "a", "03"), ("p2", "b", "04"), ("p3", "c", "03"), ("p4", "d", None)]
    # all captures again, as from a lost checkpoint: the same store
    ingest(spark, f"{root}/in", f"{root}/store", f"{root}/other").awaitTermination()
    again = spark.read.schema(PAGE).parquet(f"{root}/store").orderBy("ordinal").collect()
    assert again == rows
