"""Links with dot segments against the standard library, and capped crawls against a queue."""

import random
from collections import Counter, deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import crawl

BASES = ["https://h.x/docs/a/c", "https://h.x", "https://h.x/docs/a/", "https://h.x/docs/v1/x.html?q=1"]
LINKS = ["../b", "./b", "../../../../b", "/x/../y/./z", "..", ".", "a//b", "../", "g/./h/../i?x=/../y#../z", "a/../../b/", "...", "/..", "..g", "x/.", "/", "/a//b", "https://o.x/a/../b", "//o.x/a/../b", "b/", "", "?x=../y", "mailto:a@b", "../é/./ü"]


def test_links_resolve_as_in_the_standard_library(spark):
    rows = [(b, link) for b in BASES for link in LINKS]
    found = spark.createDataFrame(rows, "page string, link string").select("page", "link", urls.resolve(F.col("link"), F.col("page")).alias("target")).collect()
    assert {(r["page"], r["link"]): r["target"] for r in found} == {(b, link): urljoin(b, link) for b, link in rows}


def queue_crawl(start, links, good, cap):
    """First in, first out; failed pages are taken without counting, the queue stays when the pages are had."""
    queue, seen, state, fetched = deque([start]), {start}, {}, 0
    while queue and (not cap or fetched < cap):
        url = queue.popleft()
        state[url] = "fetched" if url in good else "failed"
        if url in good:
            fetched += 1
            for link in links.get(url, []):
                if link not in seen and link.startswith("https://h.x/docs/"):
                    seen.add(link)
                    queue.append(link)
    return list(state.items()) + [(u, "queued") for u in queue]


@pytest.mark.parametrize("cap", [0, 1, 7, 19])
def test_crawl_in_the_order_of_discovery(spark, cap):
    rnd = random.Random(cap)
    names = [f"https://h.x/docs/p{i}" for i in range(60)] + [f"https://h.x/blog/p{i}" for i in range(5)]
    links = {u: [rnd.choice(names) for _ in range(rnd.randrange(0, 5))] for u in names}
    links[names[0]] = names[1:6]
    good = {u for u in names if rnd.random() > 0.25} | {names[0]}
    starts = spark.createDataFrame([("a", names[0], "h.x", "/docs/"), ("b", names[9], "h.x", "/docs/")], "site string, url string, host string, prefix string")
    pages = spark.createDataFrame([(u,) for u in good], "url string")
    table = spark.createDataFrame([(u, k, v) for u, out in links.items() for k, v in enumerate(out)], "src string, pos int, dst string").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    crawled = crawl.crawl_in_order(starts, pages, table, cap)
    found = crawled.collect()
    report = {r["site"]: r for r in crawl.crawl_report(crawled).collect()}
    for site, start in (("a", names[0]), ("b", names[9])):
        mine = sorted((r for r in found if r["site"] == site), key=lambda r: (r["depth"], r["place"]))
        expected = queue_crawl(start, links, good, cap)
        assert [(r["url"], r["state"]) for r in mine] == expected
        states = Counter(s for _, s in expected)
        assert (report[site]["fetched"], report[site]["remaining"], report[site]["truncated"]) == (states["fetched"], states["queued"], states["queued"] > 0)


def test_crawl_reads_links_of_captured_pages(spark):
    """Relative links with dot segments; a failed capture is taken and leads nowhere."""
    body = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [(1, "https://h.x/docs/a/", 200, "text/html", body("../b", "./c", "../../blog/x")), (2, "https://h.x/docs/b", 500, "text/html", body("/docs/never")), (3, "https://h.x/docs/a/c", 200, "text/html", body("../b", "d/../e"))]
    captures = spark.createDataFrame(rows, "id long, url string, status int, content_type string, body string")
    starts = spark.createDataFrame([("s", "https://h.x/docs/a", "h.x", "/docs/")], "site string, url string, host string, prefix string")
    pages, links = crawl.page_links(captures)
    found = crawl.crawl_in_order(starts, pages, links).orderBy("depth", "place").collect()
    # the start is normalised, so its folder is /docs/
    assert [(r["url"], r["state"]) for r in found] == [("https://h.x/docs/a", "fetched"), ("https://h.x/b", "queued")][:1] + [("https://h.x/docs/c", "failed")]


def test_scope_ends_at_a_slash(spark):
    rows = spark.createDataFrame([("https://h.x/docs/a", "/guide"), ("https://h.x/docs/a", "/guide/"), ("https://h.x/docs/a", "host"), ("https://h.x/docs/a", None)], "start string, asked string")
    assert [r[0] for r in rows.select(crawl.scope(F.col("start"), F.col("asked"))).collect()] == ["/guide/", "/guide/", "/", "/docs/"]
