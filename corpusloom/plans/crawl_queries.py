"""Crawl, enumeration and coverage (C, A5, A14, O4) over links and maps made of the pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import crawl
from corpusloom.plans.fixtures import CAPTURES, captures, table

QUERIES, ORACLES = {}, {}
#: Hosts with their pages numbered from 1; page i links to pages 2i and 2i + 1, and back to page 1.
HEAD = """hosts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS site, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]*)', 1) ORDER BY page_id) AS i FROM pages),
places AS (SELECT site, i, 'https://' || site || CASE WHEN i % 5 = 4 THEN '/blog/' ELSE '/docs/' END || 'p' || i AS url FROM hosts),
links AS (SELECT a.site, a.url AS src, b.url AS dst FROM places a JOIN places b ON a.site = b.site AND b.i IN (2 * a.i, 2 * a.i + 1, 1))"""


def query(name: str, sql: str, recursive: bool = False):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{HEAD}{', ' + sql[1:] if sql[0] == '+' else ' ' + sql}"
        return fn

    return register


def places(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    rows = table(spark, d, "pages").select(host.alias("site"), "page_id")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("page_id")))
    return rows.select("site", "i", F.concat(F.lit("https://"), "site", F.when(F.col("i") % 5 == 4, "/blog/").otherwise("/docs/"), F.lit("p"), F.col("i").cast("string")).alias("url"))


def links(spark, d):
    p = places(spark, d)
    ahead = p.select("site", F.col("url").alias("src"), F.explode(F.array_distinct(F.array(2 * F.col("i"), 2 * F.col("i") + 1, F.lit(1)))).alias("i"))
    return ahead.join(p.withColumnRenamed("url", "dst"), ["site", "i"]).select("src", "dst")


def starts(spark, d):
    first = places(spark, d).where("i = 1").select("site", "url")
    return first.select("site", "url", F.lower("site").alias("host"), crawl.scope(F.col("url"), F.lit("section")).alias("prefix"))


REACH = "+reached(site, url, depth) AS (SELECT site, url, 0 FROM places WHERE i = 1 UNION SELECT r.site, l.dst, r.depth + 1 FROM reached r JOIN links l ON l.src = r.url WHERE l.dst LIKE '%/docs/%' AND r.depth < 40 AND l.dst NOT LIKE '%/docs/p1'), best AS (SELECT site, url, min(depth) AS depth FROM reached GROUP BY ALL)"


@query("c1_reachable", REACH + " SELECT site, url, CAST(depth AS INTEGER) AS depth FROM best", True)
def c1(spark, d):
    return crawl.reachable(starts(spark, d), links(spark, d))


ORACLES["c1_crawl_captures"] = rf"""WITH RECURSIVE {CAPTURES},
  there AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?#]*/[^?#]*[^?#/])/([?]|$)', '\1\2') AS url, body, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM captures WHERE status < 400 AND (content_type = '' OR content_type LIKE 'text/%' OR content_type LIKE '%xml' OR content_type LIKE '%json')),
  found AS (SELECT DISTINCT url AS src, regexp_replace(origin || unnest(regexp_extract_all(body, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)', 1)), '(/[^?#]*[^?#/])/$', '\1') AS dst FROM there),
  firsts AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS site, regexp_replace(regexp_replace(min(url), '#.*$', ''), '^([a-z]+://[^/?#]*/[^?#]*[^?#/])/([?]|$)', '\1\2') AS url FROM captures GROUP BY 1),
  reached(site, url) AS (SELECT site, url FROM firsts UNION SELECT r.site, f.dst FROM reached r JOIN found f ON f.src = r.url)
  SELECT site, url, url IN (SELECT url FROM there) AS fetched FROM reached"""


def c1_captures(spark, d):
    """Failed and other pages that are no text are seen and lead nowhere; the links are the pages' own."""
    site = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("site")
    first = captures(spark, d).groupBy(site).agg(F.min("url").alias("url"))
    begin = first.select("site", "url", F.lower("site").alias("host"), crawl.scope(F.col("url"), F.lit("host")).alias("prefix"))
    return crawl.crawl_captures(begin, captures(spark, d)).drop("depth")


QUERIES["c1_crawl_captures"] = c1_captures

#: Links of page i in document order, by number: written relative, with dot segments; pages whose number is 3 modulo 7 failed.
STEPS = [(2, 1), (2, 0), (0, 1), (3, 0)]


def linked_captures(spark, d):
    """Captures of the places, whose bodies link other places of their host."""
    i = F.col("i")

    def href(a: int, b: int):
        n = a * i + b
        return F.concat(F.lit('<a href="../'), F.when(n % 5 == 4, "blog").otherwise("docs"), F.lit("/./p"), n.cast("string"), F.lit('">x</a>'))

    status = F.when(i % 7 == 3, 404).otherwise(200)
    return places(spark, d).select(i.alias("id"), "url", status.alias("status"), F.lit("text/html").alias("content_type"), F.concat(*[href(a, b) for a, b in STEPS]).alias("body"))


def in_order(cap: int) -> str:
    """The crawl as a walk of at most ``cap`` steps: of all ways to a page the shortest, then the first by link positions."""
    steps = ", ".join(f"({pos}, {a}, {b})" for pos, (a, b) in enumerate(STEPS))
    return f"""WITH RECURSIVE {HEAD}, sizes AS (SELECT site, count(*) AS n FROM hosts GROUP BY site), step(pos, a, b) AS (VALUES {steps}),
  walk(site, i, depth, way) AS (SELECT site, 1::BIGINT, 0, []::INTEGER[] FROM sizes
    UNION ALL SELECT w.site, s.a * w.i + s.b, w.depth + 1, list_append(w.way, s.pos) FROM walk w JOIN sizes z ON z.site = w.site, step s
    WHERE w.depth < {cap} AND w.i <= z.n AND w.i % 7 <> 3 AND (s.a * w.i + s.b) % 5 <> 4),
  best AS (SELECT w.*, w.i <= z.n AND w.i % 7 <> 3 AS good FROM walk w JOIN sizes z ON z.site = w.site QUALIFY row_number() OVER (PARTITION BY w.site, w.i ORDER BY depth, way) = 1),
  counted AS (SELECT *, coalesce(sum(CAST(good AS INTEGER)) OVER (PARTITION BY site ORDER BY depth, way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM best),
  taken AS (SELECT site, i FROM counted WHERE good AND earlier < {cap}),
  crawled AS (SELECT site, 'https://' || site || '/docs/p' || i AS url, depth, row_number() OVER (PARTITION BY site, depth ORDER BY way) - 1 AS place,
    CASE WHEN earlier >= {cap} THEN 'queued' WHEN good THEN 'fetched' ELSE 'failed' END AS state
    FROM counted c WHERE i = 1 OR EXISTS (SELECT 1 FROM taken t, step s WHERE t.site = c.site AND s.a * t.i + s.b = c.i))"""


def ordered(spark, d, cap: int):
    pages, found = crawl.page_links(linked_captures(spark, d))
    return crawl.crawl_in_order(starts(spark, d), pages, found, cap)


QUERIES["c1_c6_capped_crawl"] = lambda spark, d: ordered(spark, d, 3)
ORACLES["c1_c6_capped_crawl"] = in_order(3) + " SELECT * FROM crawled"
QUERIES["c2_capped_crawl_report"] = lambda spark, d: crawl.crawl_report(ordered(spark, d, 3))
ORACLES["c2_capped_crawl_report"] = in_order(3) + " SELECT site, count(*) FILTER (WHERE state = 'fetched') AS fetched, count(*) FILTER (WHERE state = 'queued') AS remaining, count(*) FILTER (WHERE state <> 'failed') AS discovered, count(*) FILTER (WHERE state = 'queued') > 0 AS truncated FROM crawled GROUP BY site"

CAPPED = REACH + ", fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, url) AS rank FROM best) WHERE rank <= 3)"


@query("c2_crawl_statistics", CAPPED + ", known AS (SELECT DISTINCT f.site, l.dst AS url FROM fetched f JOIN links l ON l.src = f.url UNION SELECT site, url FROM fetched), n AS (SELECT k.site, count(*) AS discovered FROM known k JOIN best b ON b.site = k.site AND b.url = k.url GROUP BY 1) SELECT n.site, (SELECT count(*) FROM fetched f WHERE f.site = n.site) AS fetched, discovered - (SELECT count(*) FROM fetched f WHERE f.site = n.site) AS remaining, discovered, discovered > (SELECT count(*) FROM fetched f WHERE f.site = n.site) AS truncated FROM n", True)
def c2(spark, d):
    reached = crawl.reachable(starts(spark, d), links(spark, d))
    return crawl.statistics(reached, links(spark, d), crawl.capped(reached, ["url"], 3))


# a harvest: no cap
@query("c2_crawl_statistics_harvest", CAPPED.replace(" WHERE rank <= 3", "") + ", known AS (SELECT DISTINCT f.site, l.dst AS url FROM fetched f JOIN links l ON l.src = f.url UNION SELECT site, url FROM fetched), n AS (SELECT k.site, count(*) AS discovered FROM known k JOIN best b ON b.site = k.site AND b.url = k.url GROUP BY 1) SELECT n.site, (SELECT count(*) FROM fetched f WHERE f.site = n.site) AS fetched, discovered - (SELECT count(*) FROM fetched f WHERE f.site = n.site) AS remaining, discovered, discovered > (SELECT count(*) FROM fetched f WHERE f.site = n.site) AS truncated FROM n", True)
def c2_harvest(spark, d):
    reached = crawl.reachable(starts(spark, d), links(spark, d))
    return crawl.statistics(reached, links(spark, d), crawl.capped(reached, ["url"], 0))


def scopes(spark, d):
    return starts(spark, d).select("site", "host", "prefix")


@query("c4_enumerate", "+listed AS (SELECT site, url, 'index' AS source FROM places WHERE i % 3 = 0 UNION ALL SELECT site, url, 'sitemap' FROM places WHERE i % 2 = 0 AND url LIKE '%/docs/%'), n AS (SELECT site, count(DISTINCT url) AS expected, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM listed GROUP BY site) SELECT p.site, n.expected, coalesce(n.sources, '') AS sources FROM (SELECT site FROM places WHERE i = 1) p LEFT JOIN n USING (site)")
def c4(spark, d):
    p = places(spark, d)
    index = p.where("i % 3 = 0").select("site", F.concat("url", F.lit("/#top")).alias("url"))
    return crawl.enumerate_pages(index, p.where("i % 2 = 0").select("site", "url"), scopes(spark, d))


@query("c5_strategy", "+n AS (SELECT site, count(*) AS pages, count(*) FILTER (WHERE url LIKE '%/docs/%') AS in_scope FROM places GROUP BY site) SELECT site, CASE WHEN length(site) % 3 = 0 AND NOT length(site) % 2 = 0 THEN 'artifact' WHEN in_scope >= 3 THEN 'sitemap' ELSE 'crawl' END AS strategy FROM n")
def c5(spark, d):
    n = places(spark, d).join(scopes(spark, d), "site").groupBy("site").agg(F.count_if(urls.crawlable(F.col("url"), F.col("host"), F.col("prefix"))).alias("in_scope"))
    return n.select("site", crawl.strategy(F.length("site") % 3 == 0, F.length("site") % 2 == 0, F.lit(True), F.col("in_scope")).alias("strategy"))


@query("a5_coverage_note", "SELECT site AS harvest, count(*) FILTER (WHERE i % 4 = 3) = 0 AS whole, CASE WHEN count(*) FILTER (WHERE i % 4 = 3) > 0 THEN 'the index names a fuller file' ELSE '' END AS reason FROM places GROUP BY site")
def a5(spark, d):
    body = F.when(F.col("i") % 4 == 3, F.lit("- [Full](/llms-full.txt)")).otherwise("- [Page](/x)")
    return crawl.coverage_note(places(spark, d).select(F.col("site").alias("harvest"), body.alias("body")))


@query("a14_first_seen", "+twice AS (SELECT site, url, i AS pos FROM places UNION ALL SELECT site, url, i + 100 FROM places WHERE i % 2 = 0) SELECT site, url, min(pos) AS pos FROM twice GROUP BY ALL")
def a14(spark, d):
    p = places(spark, d).select("site", "url", F.col("i").cast("long").alias("pos"))
    return crawl.first_seen(p.union(p.where("pos % 2 = 0").select("site", "url", F.col("pos") + 100)))


@query("o4_not_stored", "SELECT site, url FROM places WHERE i % 6 = 0")
def o4(spark, d):
    p = places(spark, d).select("site", "url", "i")
    listed = p.select("site", "url")
    return crawl.not_stored(listed.union(listed), p.where("i % 6 <> 0").select("site", "url"))
