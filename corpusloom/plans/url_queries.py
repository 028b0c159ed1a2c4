"""URL expressions (U1-U18, S3) over the URL table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import urls as u
from corpusloom.plans.fixtures import AS_OF, HOST_SQL, PATH_SQL, URLS, urls

QUERIES, ORACLES = {}, {}
SEGMENTS = f"list_filter(string_split({PATH_SQL}, '/'), lambda s: s <> '')"
VERSIONED = r"'[vV]?\d+(\.\d+)*'"


def _register(name: str, columns, sql: str, with_urls: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: urls(spark, sf_dir).select("id", *columns())
    ORACLES[name] = f"WITH {URLS}{with_urls} SELECT id, {sql} FROM urls"


def _url():
    return F.col("url")


_register("u1_normalise_url", lambda: [u.normalise(_url()).alias("normalised")], r"regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*[^?#/])/(\?|$)', '\1\2') AS normalised")
_register(
    "u3_docs_scope",
    lambda: [u.docs_scope(_url()).alias("scope")],
    f"""(WITH s AS (SELECT {SEGMENTS} AS p), r AS (
      SELECT p, coalesce(list_position(list_transform(p, lambda x: lower(x) IN ('docs','doc','documentation','guide','guides','manual','reference','learn','handbook','api')), true), 0) AS i FROM s),
      v AS (SELECT p, i, coalesce(list_position(list_transform(p[i + 1:i + 3], lambda x: regexp_full_match(x, {VERSIONED})), true), 0) AS j FROM r)
      SELECT CASE WHEN len(p) = 0 THEN '/' WHEN i > 0 THEN '/' || array_to_string(p[1:i + j], '/') || '/'
        WHEN len(p) > 1 OR contains(p[-1], '.') THEN CASE WHEN len(p) = 1 THEN '/' ELSE '/' || array_to_string(p[1:len(p) - 1], '/') || '/' END
        ELSE '/' || p[1] || '/' END FROM v) AS scope""",
)
_register(
    "u4_crawlable",
    lambda: [u.crawlable(_url(), u.host(_url()), F.lit("/en/")).alias("in_en"), u.crawlable(_url(), u.host(_url()), F.lit("/")).alias("in_site")],
    ", ".join(
        rf"(starts_with(lower(url), 'http') AND NOT regexp_matches(lower({PATH_SQL}), '\.(png|jpg|jpeg|gif|svg|webp|ico|bmp|pdf|zip|tar|gz|bz2|xz|7z|rar|mp4|webm|mp3|wav|ogg|mov|avi|woff|woff2|ttf|otf|eot|exe|dmg|msi|deb|rpm|whl|jar|css|js|map)$') AND starts_with(rtrim({PATH_SQL}, '/') || '/', '{p}')) AS {name}"
        for p, name in (("/en/", "in_en"), ("/", "in_site"))
    ),
)
_register("u7_names_version", lambda: [u.names_version(_url()).alias("names_version")], f"len(list_filter({SEGMENTS}, lambda s: regexp_full_match(s, {VERSIONED}))) > 0 AS names_version")
_register(
    "u8_version_from_url",
    lambda: [u.version_of(_url(), F.lit(AS_OF).cast("timestamp")).alias("version")],
    rf"coalesce(list_filter(list_transform({SEGMENTS}, lambda s: lower(s)), lambda s: regexp_full_match(s, 'v\d+(\.\d+)*|\d+(\.\d+)+|latest|stable|next|canary'))[1], '{AS_OF}') AS version",
)
_register("u10_name_from_url", lambda: [u.name_of(_url()).alias("name")], f"split_part(regexp_replace(regexp_replace({HOST_SQL}, '^www[.]', ''), '^docs[.]', ''), '.', 1) AS name")
_register(
    "u11_file_slug",
    lambda: [u.file_slug(_url()).alias("file")],
    f"left(regexp_replace(regexp_replace({HOST_SQL} || {PATH_SQL}, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) || '-' || left(sha1(url), 8) AS file",
)
_register(
    "u12_key_slug",
    lambda: [u.key_slug(_url()).alias("slug"), u.anchor(_url()).alias("anchor")],
    "coalesce(nullif(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'untitled') AS slug, coalesce(nullif(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'section') AS anchor",
)
_register(
    "u15_host_and_forge",
    lambda: [u.bare_host(_url()).alias("host"), u.is_forge(F.regexp_replace("url", r"example\.(org|net)", "github.com")).alias("forge")],
    f"regexp_replace({HOST_SQL}, '^www[.]', '') AS host, regexp_matches({HOST_SQL}, '(^|[.])example[.](org|net)$') AS forge",
)
_register(
    "u16_docs_host",
    lambda: [u.is_docs_host(_url()).alias("docs_host"), u.looks_like_docs(_url()).alias("docs_like")],
    f"regexp_matches(regexp_replace({HOST_SQL}, '^www[.]', ''), '^(docs|developer|devdocs)[.]') AS docs_host, (starts_with(regexp_replace({HOST_SQL}, '^www[.]', ''), 'docs.') OR regexp_matches(lower({PATH_SQL}), '/docs|/documentation|/guide')) AS docs_like",
)
_register(
    "u17_owns_name",
    lambda: [u.owns_name(_url(), F.regexp_extract("url", "th([a-z]+)[.]", 0).substr(F.lit(1), F.lit(6))).alias("owns")],
    f"list_contains(string_split(regexp_replace({HOST_SQL}, '^www[.]', ''), '.'), substr(regexp_extract(url, 'th([a-z]+)[.]', 0), 1, 6)) AS owns",
)
_register(
    "s3_admissible_urls",
    lambda: [u.admissible(_url()).alias("admissible")],
    rf"""(regexp_matches(lower(url), '^https?://[^/]') AND CASE WHEN regexp_full_match({HOST_SQL}, '\d{{1,3}}[.]\d{{1,3}}[.]\d{{1,3}}[.]\d{{1,3}}') THEN
      NOT (CAST(split_part({HOST_SQL}, '.', 1) AS INT) IN (0, 10, 127) OR CAST(split_part({HOST_SQL}, '.', 1) AS INT) >= 224
        OR (CAST(split_part({HOST_SQL}, '.', 1) AS INT) = 172 AND CAST(split_part({HOST_SQL}, '.', 2) AS INT) BETWEEN 16 AND 31)) ELSE true END) AS admissible""",
)


def _focus(spark, sf_dir):
    """U5 and U6 for each site whose scope is the whole host: sets decide, so only keys go through the windows."""
    rows = urls(spark, sf_dir).select("id", "url", u.host(_url()).alias("site"), u.docsy(_url()).alias("docsy"), u.marketing(_url()).alias("marketing"), u.locale(_url()).alias("locale"))
    per_site = rows.groupBy("site").agg(F.count_if("docsy").alias("n_docsy"), F.count_if(~F.col("marketing")).alias("n_rest"), F.count_distinct("locale").alias("n_locales"), F.count_if(F.col("locale").isin("", "en")).alias("n_default"))
    both = rows.join(per_site, "site")
    focus = F.when(F.col("n_docsy") >= 5, F.col("docsy")).when(F.col("n_rest") > 0, ~F.col("marketing")).otherwise(True)
    default = F.when((F.col("n_locales") < 2) | (F.col("n_default") == 0), True).otherwise(F.col("locale").isin("", "en"))
    return both.select("id", focus.alias("docs_focus"), default.alias("default_locale"))


QUERIES["u5_u6_focus_and_locale"] = _focus
ORACLES["u5_u6_focus_and_locale"] = rf"""WITH {URLS}, r AS (
  SELECT id, {HOST_SQL} AS site, regexp_matches(lower({PATH_SQL}), '/(docs?|documentation|guide|guides|manual|reference|api|learn|tutorial)(/|$)') AS docsy,
    regexp_matches(lower({PATH_SQL}), '/(blog|news|posts?|articles?|changelog|releases?|careers?|jobs|pricing|about|contact|team|events?|showcase|agencies|partners|sponsors|store|shop|legal|privacy|terms|press|community)(/|$)') AS marketing,
    CASE WHEN regexp_extract(lower({PATH_SQL}), '^/([a-z]{{2}})(?:-[a-z]{{2}})?(?:/|$)', 1) IN ('ar','bn','cs','da','de','el','es','fa','fi','fr','he','hi','hu','id','it','ja','ko','ms','nl','no','pl','pt','ro','ru','sv','th','tr','uk','vi','zh','en')
      THEN regexp_extract(lower({PATH_SQL}), '^/([a-z]{{2}})(?:-[a-z]{{2}})?(?:/|$)', 1) ELSE '' END AS locale FROM urls),
s AS (SELECT site, count(*) FILTER (WHERE docsy) AS n_docsy, count(*) FILTER (WHERE NOT marketing) AS n_rest, count(DISTINCT locale) AS n_locales, count(*) FILTER (WHERE locale IN ('', 'en')) AS n_default FROM r GROUP BY site)
SELECT id, CASE WHEN n_docsy >= 5 THEN docsy WHEN n_rest > 0 THEN NOT marketing ELSE true END AS docs_focus,
  CASE WHEN n_locales < 2 OR n_default = 0 THEN true ELSE locale IN ('', 'en') END AS default_locale FROM r JOIN s USING (site)"""


def _links(spark, sf_dir):
    """U2 over links of several kinds, against each URL as the page."""
    kinds = F.array(*map(F.lit, ["/abs/x", "rel/y", "//other.example.com/z", "#frag", "?q=1", "https://full.example.com/", "mailto:a@example.com", "../up", "./here?x=/../y", "/a/./b/../c", "../../../../../../top#../z", "x/../", ".."]))
    rows = urls(spark, sf_dir).select("id", "url", F.posexplode(kinds).alias("pos", "link"))
    return rows.select("id", "pos", u.resolve(F.col("link"), _url()).alias("target"))


QUERIES["u2_resolve_link"] = _links
ORACLES["u2_resolve_link"] = rf"""WITH {URLS}, l AS (
  SELECT id, url, unnest(range(13)) AS pos, unnest(['/abs/x', 'rel/y', '//other.example.com/z', '#frag', '?q=1', 'https://full.example.com/', 'mailto:a@example.com', '../up', './here?x=/../y', '/a/./b/../c', '../../../../../../top#../z', 'x/../', '..']) AS link,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, {PATH_SQL} AS path, CASE WHEN {PATH_SQL} = '' THEN '/' ELSE regexp_extract({PATH_SQL}, '^(.*/)', 1) END AS folder FROM urls)
SELECT id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN origin || link WHEN 1 THEN origin || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link
  WHEN 2 THEN split_part(url, ':', 1) || ':' || link WHEN 3 THEN regexp_replace(url, '#.*$', '') || link WHEN 4 THEN origin || path || link
  WHEN 7 THEN origin || regexp_replace(folder, '[^/]+/$', '') || 'up' WHEN 8 THEN origin || folder || 'here?x=/../y' WHEN 9 THEN origin || '/a/c' WHEN 10 THEN origin || '/top#../z'
  WHEN 11 THEN origin || folder WHEN 12 THEN origin || regexp_replace(folder, '[^/]+/$', '') ELSE link END AS target FROM l"""


def _remotes(spark, sf_dir):
    """U14 and U18 over git remotes made from the URLs."""
    rest = F.regexp_replace("url", "^https?://", "")
    i = F.col("id") % 5
    remote = F.when(i == 0, F.concat(F.lit("git+https://"), rest, F.lit(".git"))).when(i == 1, F.concat(F.lit("git://"), rest)).when(i == 2, F.concat(F.lit("ssh://git@"), rest)).when(i == 3, F.concat(F.lit("git@host.example.com:"), rest)).otherwise(rest)
    return urls(spark, sf_dir).select("id", u.clean_remote(remote).alias("remote"), u.at_root(_url(), F.lit("https://x.example.com/a/b")).alias("at_root"))


QUERIES["u14_clean_remote"] = _remotes
ORACLES["u14_clean_remote"] = rf"""WITH {URLS} SELECT id, CASE id % 5 WHEN 0 THEN 'https://' || regexp_replace(url, '^https?://', '')
  WHEN 3 THEN regexp_replace('https://host.example.com/' || regexp_replace(url, '^https?://', ''), '[.]git$', '') WHEN 4 THEN '' ELSE regexp_replace('https://' || regexp_replace(url, '^https?://', ''), '[.]git$', '') END AS remote,
  length(regexp_replace({PATH_SQL}, '[^/]', '', 'g')) = 1 AS at_root FROM urls"""
