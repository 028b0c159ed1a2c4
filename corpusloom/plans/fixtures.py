"""Inputs of the registered queries, derived from the given tables, and the same as SQL.

Each builder has a SQL twin (a common table expression of the same name) that the oracles begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2026-08-20"
HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"
PATH_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


#: Rows of ``part`` for each task that makes names, pages and manifests of them.
ROWS_A_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. ``part`` has few bytes a row and much work, and a file may be one task, so its rows are dealt over tasks."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "part":
        return rows
    return rows.repartition(8 + rows.count() // ROWS_A_TASK, "p_partkey")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, url``: page URLs, documentation-shaped variants of them, and address literals."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    k = (F.col("page_id") % 5).cast("string")
    docs = F.concat(F.lit("https://docs."), host, F.lit("/docs/v"), k, F.lit("/guide/p"), F.col("page_id").cast("string"), F.lit("/#part"))
    nested = F.concat(F.lit("https://"), host, F.lit("/Reference/api/2."), k, F.lit("/x"), F.col("page_id").cast("string"), F.lit(".html"))
    literal = F.concat(F.lit("http://"), (F.col("page_id") % 256).cast("string"), F.lit(".16.0.1/latest/blog/a.png"))
    parts = [p.select((F.col("page_id") * 4 + i).alias("id"), u.alias("url")) for i, u in enumerate((F.col("url"), docs, nested, literal))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


URLS = r"""urls AS (
  SELECT page_id * 4 AS id, url FROM pages
  UNION ALL SELECT page_id * 4 + 1, 'https://docs.' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/docs/v' || (page_id % 5) || '/guide/p' || page_id || '/#part' FROM pages
  UNION ALL SELECT page_id * 4 + 2, 'https://' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/Reference/api/2.' || (page_id % 5) || '/x' || page_id || '.html' FROM pages
  UNION ALL SELECT page_id * 4 + 3, 'http://' || (page_id % 256) || '.16.0.1/latest/blog/a.png' FROM pages)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, url, status, content_type, body``."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("id"),
        "url",
        F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 23 == 0, "image/png").when(F.col("page_id") % 29 == 0, "").when(F.col("page_id") % 31 == 0, "application/xml").otherwise("text/html").alias("content_type"),
        F.col("html").alias("body"),
    )


CAPTURES = """captures AS (
  SELECT page_id AS id, url, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status,
    CASE WHEN page_id % 23 = 0 THEN 'image/png' WHEN page_id % 29 = 0 THEN '' WHEN page_id % 31 = 0 THEN 'application/xml' ELSE 'text/html' END AS content_type,
    html AS body FROM pages)"""

LABELS = ["1.9", "1.10", "2.11", "2.0-rc1", "2026-08-20", "latest"]


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page store: ``technology, version, ordinal, title, url, content``; ordinals may have gaps."""
    d = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    version = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(
        F.col("source").alias("technology"),
        version.alias("version"),
        (F.floor(F.col("doc_id") / 6) + 1).cast("long").alias("ordinal"),
        F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(60)).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.dev/docs/"), version, F.lit("/p"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
    )


STORE = """store AS (
  SELECT technology, version, ordinal, title, 'https://' || technology || '.example.dev/docs/' || version || '/p' || doc_id AS url, content FROM (
    SELECT source AS technology, (['1.9', '1.10', '2.11', '2.0-rc1', '2026-08-20', 'latest'])[(doc_id % 6) + 1] AS version,
      doc_id // 6 + 1 AS ordinal, left(split_part(text, chr(10), 1), 60) AS title, doc_id, text AS content
    FROM documents WHERE source IS NOT NULL AND text IS NOT NULL))"""


def doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``technology, version, source, strategy, complete, expected, harvested_at`` of the store's versions."""
    d = store(spark, sf_dir).groupBy("technology", "version").agg(F.min("ordinal").alias("k"), F.count("*").alias("n"))
    return d.select(
        "technology",
        "version",
        F.concat(F.lit("https://"), F.col("technology"), F.lit(".example.dev/docs/"), F.col("version")).alias("source"),
        F.when(F.col("k") % 2 == 0, "sitemap").otherwise("html").alias("strategy"),
        F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False).alias("complete"),
        F.when(F.col("k") % 4 != 0, F.col("n") + F.col("k") % 2).alias("expected"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("k") * 60).alias("harvested_at"),
    )


DOC_VERSIONS = (
    STORE
    + """, doc_versions AS (
  SELECT technology, version, 'https://' || technology || '.example.dev/docs/' || version AS source,
    CASE WHEN k % 2 = 0 THEN 'sitemap' ELSE 'html' END AS strategy,
    CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS complete,
    CASE WHEN k % 4 <> 0 THEN n + k % 2 END AS expected,
    TIMESTAMP '2026-01-01' + to_seconds(k * 60) AS harvested_at
  FROM (SELECT technology, version, min(ordinal) AS k, count(*) AS n FROM store GROUP BY ALL))"""
)

#: The label's sort key as a DuckDB expression over ``version``: kind, numbers, final, suffix.
KEY_SQL = r"""struct_pack(
  kind := CASE WHEN regexp_full_match(version, '\d{4}-\d{2}-\d{2}') THEN 1 WHEN regexp_matches(version, '^[vV]?\d') THEN 2 ELSE 0 END,
  parts := CASE WHEN regexp_full_match(version, '\d{4}-\d{2}-\d{2}') THEN list_transform(string_split(version, '-'), lambda x: CAST(x AS BIGINT))
    WHEN regexp_matches(version, '^[vV]?\d') THEN list_transform(string_split(regexp_extract(version, '^[vV]?(\d+(?:\.\d+)*)', 1), '.'), lambda x: CAST(x AS BIGINT)) ELSE [] END,
  is_final := CASE WHEN regexp_matches(version, '^[vV]?\d') AND NOT regexp_full_match(version, '\d{4}-\d{2}-\d{2}') AND regexp_extract(version, '^[vV]?\d+(?:\.\d+)*[-+.]?(.*)$', 1) = '' THEN 1 ELSE 0 END,
  suffix := CASE WHEN regexp_matches(version, '^[vV]?\d') AND NOT regexp_full_match(version, '\d{4}-\d{2}-\d{2}') THEN regexp_extract(version, '^[vV]?\d+(?:\.\d+)*[-+.]?(.*)$', 1) ELSE '' END)"""
