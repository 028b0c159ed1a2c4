"""Crawl and enumeration: what can be reached from a start page, and what a site says that it publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import extract
from corpusloom.session import materialise, number_rows
from corpusloom.sources.captures import admitted

#: Rounds of a crawl between two rewritings of what was seen.
ROUNDS_A_TABLE = 20


def scope(start: Column, asked: Column) -> Column:
    """The prefix that a crawl stays inside: '/' for ``host``, the start's own for '' and ``section``, else as asked, up to a slash."""
    whole = F.when(asked.endswith("/"), asked).otherwise(F.concat(asked, F.lit("/")))
    return F.when(asked == "host", "/").when(F.coalesce(asked, F.lit("")).isin("", "section"), urls.docs_scope(start)).otherwise(whole)


def reachable(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(site, url, depth) of the pages reached from each site's start over links that its scope admits.

    ``starts``: site, url, host, prefix; ``links``: src, dst. One round for each depth: the frontier joins the
    links, pages seen before go. The rounds end when no page is new, however deep the last one lies. Starts are not
    checked against the scope.
    """
    site = starts.select("site", "host", "prefix")
    seen = materialise(starts.select("site", "url", F.lit(0).alias("depth")))
    frontier, depth = seen, 0
    while True:
        depth += 1
        found = frontier.join(links.withColumnRenamed("src", "url").withColumnRenamed("dst", "next"), "url").join(site, "site")
        found = found.where(urls.crawlable(F.col("next"), F.col("host"), F.col("prefix"))).select("site", F.col("next").alias("url")).distinct()
        frontier = materialise(found.join(seen, ["site", "url"], "left_anti").select("site", "url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            return seen
        # one table again from time to time, so that a deep crawl does not read a table for each depth
        seen = materialise(seen.unionByName(frontier)) if depth % ROUNDS_A_TABLE == 0 else seen.unionByName(frontier)


def page_links(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages that a crawl can read (url), and their links (src, pos, dst), written once; both normalised.

    Of several captures of one URL the smallest id's counts.
    """
    pages = admitted(captures).withColumn("url", urls.normalise(F.col("url")))
    first = pages.groupBy("url").agg(F.min("id").alias("id"))
    one = pages.join(first, ["url", "id"]).dropDuplicates(["url"])
    targets = extract.links(one.select(F.col("url").alias("id"), "url", "body")).select(F.col("id").alias("src"), "pos", F.col("target").alias("dst"))
    return materialise(first.select("url")), materialise(targets.groupBy("src", "dst").agg(F.min("pos").alias("pos")))


def crawl_in_order(starts: DataFrame, pages: DataFrame, links: DataFrame, cap: int = 0) -> DataFrame:
    """(site, url, depth, place, state) of a crawl that takes pages in the order of discovery, at most ``cap`` (0: no cap).

    ``starts``: site, url, host, prefix; ``pages``: url of those that can be read; ``links``: src, pos, dst. A URL is
    discovered by the page that was taken first among those that link it, at its first link there; ``place`` is its
    place within its depth. ``state``: ``fetched``; ``failed``, which was taken, does not count and leads nowhere; ``queued``,
    which is left when the site has its pages. A site goes no further then, so that a capped crawl reads the links of
    its own pages only. Each depth is ordered by ranges, not in one task a site.
    """
    site, there = starts.select("site", "host", "prefix"), pages.select("url", F.lit(True).alias("good"))
    new, seen, depth = starts.select("site", "url", F.lit(0).cast("long").alias("place")), None, 0
    while True:
        level = materialise(new.join(there, "url", "left").select("site", "url", "place", F.coalesce("good", F.lit(False)).alias("good")))
        if level.isEmpty():
            return seen
        if cap:
            taken = seen.where("state = 'fetched'").groupBy("site").agg(F.count("*").alias("taken")) if seen else None
            room = site.join(taken, "site", "left") if seen else site.withColumn("taken", F.lit(0))
            room = room.select("site", (F.lit(cap) - F.coalesce("taken", F.lit(0))).alias("room"))
            nth = number_rows(level.where("good").select("site", "place"), ["site"], [F.col("place")])
            # where a site's last page stands, if it is at this depth
            cut = nth.join(room, "site").where(F.col("number") == F.col("room") - 1).select("site", F.col("place").alias("cut"))
            level = level.join(room, "site").join(cut, "site", "left").withColumn("open", (F.col("room") > 0) & (F.col("place") <= F.coalesce("cut", F.col("place"))))
        else:
            level = level.withColumn("open", F.lit(True))
        state = F.when(~F.col("open"), "queued").when(F.col("good"), "fetched").otherwise("failed")
        done = materialise(level.select("site", "url", F.lit(depth).alias("depth"), "place", state.alias("state")))
        seen = done if seen is None else seen.unionByName(done)
        if depth % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1:
            seen = materialise(seen)
        depth += 1
        ahead = done.where("state = 'fetched'").select("site", F.col("url").alias("src"), "place").join(links, "src").join(site, "site")
        ahead = ahead.where(urls.crawlable(F.col("dst"), F.col("host"), F.col("prefix")))
        found = ahead.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("place", "pos")).alias("by")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        ranked = number_rows(found.select("site", "url", F.col("by.place").alias("p"), F.col("by.pos").alias("q")), ["site"], [F.col("p"), F.col("q")])
        new = ranked.select("site", "url", F.col("number").alias("place"))


def crawl_report(crawled: DataFrame) -> DataFrame:
    """Per site of ``crawl_in_order``: pages fetched, URLs left in the queue, their sum, and whether the cap cut it short."""
    n = crawled.groupBy("site").agg(F.count_if(F.col("state") == "fetched").alias("fetched"), F.count_if(F.col("state") == "queued").alias("remaining"))
    return n.select("site", "fetched", "remaining", (F.col("fetched") + F.col("remaining")).alias("discovered"), (F.col("remaining") > 0).alias("truncated"))


def crawl_captures(starts: DataFrame, captures: DataFrame) -> DataFrame:
    """(site, url, depth, fetched) of a crawl over captured pages, whose own links it follows.

    ``captures``: id, url, status, content_type, body. A URL that was not captured, failed or is no text counts as
    seen, is not fetched, and leads nowhere. Starts and links are normalised, and links resolve against that form.
    """
    pages = admitted(captures).withColumn("url", urls.normalise(F.col("url")))
    targets = extract.links(pages.select(F.col("url").alias("id"), "url", "body")).select(F.col("id").alias("src"), F.col("target").alias("dst"))
    # the bodies are read once, not once a depth
    found = reachable(starts.withColumn("url", urls.normalise(F.col("url"))), materialise(targets.distinct()))
    there = pages.select("url", F.lit(True).alias("fetched")).distinct()
    return found.join(there, "url", "left").select("site", "url", "depth", F.coalesce("fetched", F.lit(False)).alias("fetched"))


def capped(reached: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The pages that a crawl of at most ``cap`` pages fetches, first come first (0: no cap)."""
    place = Window.partitionBy("site").orderBy("depth", *order)
    return reached.withColumn("rank", F.row_number().over(place)).where((F.col("rank") <= cap) | F.lit(cap == 0)).drop("rank")


def statistics(reached: DataFrame, links: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per site: fetched pages, and discovered but not fetched ones; truncated where any remain."""
    known = fetched.select("site", F.col("url").alias("src")).join(links, "src").select("site", F.col("dst").alias("url")).union(fetched.select("site", "url")).distinct()
    known = known.join(reached.select("site", "url"), ["site", "url"], "left_semi")
    n = known.groupBy("site").agg(F.count("*").alias("discovered")).join(fetched.groupBy("site").agg(F.count("*").alias("fetched")), "site")
    remaining = F.col("discovered") - F.col("fetched")
    return n.select("site", "fetched", remaining.alias("remaining"), "discovered", (remaining > 0).alias("truncated"))


def enumerate_pages(index: DataFrame, sitemap: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per site the distinct pages that its index or sitemap names in scope: how many (null: none), and which sources say so."""
    both = index.select("site", "url", F.lit("index").alias("source")).union(sitemap.select("site", "url", F.lit("sitemap").alias("source")))
    rows = both.withColumn("url", urls.normalise(F.col("url"))).join(scopes, "site")
    inside = rows.where((F.col("source") == "index") | urls.crawlable(F.col("url"), F.col("host"), F.col("prefix")))
    listed = inside.groupBy("site").agg(F.count_distinct("url").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return scopes.select("site").join(listed, "site", "left").select("site", F.nullif(F.coalesce("n", F.lit(0)), F.lit(0)).alias("expected"), F.coalesce("sources", F.lit("")).alias("sources"))


def strategy(artifact: Column, wants_version: Column, at_root: Column, in_scope: Column) -> Column:
    """How a site is harvested: its single artifact unless a version was asked for and it was found at the root, a sitemap of 3 pages or more, else a crawl."""
    return F.when(artifact & ~(wants_version & at_root), "artifact").when(in_scope >= 3, "sitemap").otherwise("crawl")


def coverage_note(harvests: DataFrame) -> DataFrame:
    """(harvest, whole, reason) of harvests (harvest, body): one that names a fuller dump is not whole."""
    fuller = F.left("body", F.lit(200_000)).rlike(r"llms-(full|medium)\.txt")
    out = harvests.groupBy("harvest").agg(F.bool_or(fuller).alias("fuller"))
    return out.select("harvest", (~F.col("fuller")).alias("whole"), F.when(F.col("fuller"), "the index names a fuller file").otherwise("").alias("reason"))


def not_stored(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed pages (site, url) that are not stored."""
    return listed.distinct().join(stored, ["site", "url"], "left_anti")


def first_seen(rows: DataFrame) -> DataFrame:
    """Distinct (site, url) with the position where each came first."""
    return rows.groupBy("site", "url").agg(F.min("pos").alias("pos"))
