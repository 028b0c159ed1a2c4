"""Scans over tables of captured responses (url, status, content_type, body) and over files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.session import ship_package

# Where sitemaps usually lie, which manifests are read and which folders are not.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap-0.xml", "/docs/sitemap.xml"]
MANIFESTS = ["package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod"]
SKIPPED_FOLDERS = ["node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", "target", ".next", ".nuxt", "vendor", ".claude"]


def admitted(captures: DataFrame) -> DataFrame:
    """Captures that are text: status below 400 and no content type, ``text/*``, xml or json."""
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    return captures.where((F.col("status") < 400) & ((kind == "") | kind.startswith("text/") | kind.endswith("xml") | kind.endswith("json")))


def _decoded(body: bytes, charset: str) -> str:
    """Bytes by a charset's name, what it does not know replaced; by UTF-8 where no codec has the name."""
    try:
        text = body.decode(charset, "replace")
    except (LookupError, ValueError):
        text = body.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode("utf-8")


def _decoded_batch(bodies: pa.Array, charsets: pa.Array) -> pa.Array:
    pairs = zip(bodies, charsets, strict=True)
    return pa.array([_decoded(b.as_py(), c.as_py()) if b.is_valid and c.is_valid else None for b, c in pairs], pa.string())


def decoded(captures: DataFrame) -> DataFrame:
    """``body`` bytes as text, by the declared charset, else UTF-8; bytes without a character become U+FFFD, null stays.

    UTF-8 and Latin-1 are decoded by Spark; only bodies of other charsets go to Python, in Arrow batches. A name that
    no codec has counts as UTF-8.
    """
    ship_package(captures.sparkSession)
    charset = F.lower(F.regexp_extract(F.coalesce("content_type", F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:+-]+)", 1))
    body, latin = F.col("body").cast("binary"), charset.isin("iso-8859-1", "latin1", "latin-1")
    other = ~latin & ~charset.isin("", "utf-8", "utf8")
    foreign = F.arrow_udf(_decoded_batch, "string")(F.when(other, body), F.when(other, charset))
    return captures.withColumn("body", F.when(latin, F.decode(body, "ISO-8859-1")).when(other, foreign).otherwise(F.make_valid_utf8(body.cast("string"))))


def locations(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>"), 1)


def sitemap_links(sitemaps: DataFrame, levels: int = 2) -> DataFrame:
    """(site, loc) of every page that sitemaps list; an index is followed ``levels`` deep at most.

    ``sitemaps``: url, body. Nested maps are found by joining the table with itself on the URL.
    """
    index = F.col("body").contains("<sitemapindex")
    found = sitemaps.select(F.col("url").alias("site"), index.alias("is_index"), F.explode(locations(F.col("body"))).alias("loc"))
    pages, nested = found.where("not is_index").select("site", "loc"), found.where("is_index").select("site", "loc")
    for _ in range(levels - 1):
        below = nested.join(sitemaps.select(F.col("url").alias("loc"), "body"), "loc").select("site", F.col("body").contains("<sitemapindex").alias("is_index"), F.explode(locations(F.col("body"))).alias("loc"))
        pages = pages.union(below.where("not is_index").select("site", "loc"))
        nested = below.where("is_index").select("site", "loc")
    return pages.distinct()


def locate_sitemaps(origins: DataFrame, robots: DataFrame, captures: DataFrame) -> DataFrame:
    """Each origin's sitemap: the first ``Sitemap:`` line of its robots text, else the first usual path captured as XML."""
    lines = robots.select("origin", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    named = lines.select("origin", F.lit(0).alias("tier"), "pos", F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)).alias("sitemap")).where("sitemap <> ''")
    usual = origins.select("origin", F.lit(1).alias("tier"), F.posexplode(F.array(*map(F.lit, SITEMAP_PATHS))).alias("pos", "path")).select("origin", "tier", "pos", F.concat("origin", "path").alias("sitemap"))
    xml = captures.where((F.col("status") == 200) & F.col("content_type").contains("xml")).select(F.col("url").alias("sitemap"))
    both = named.union(usual.join(xml, "sitemap", "left_semi").select("origin", "tier", "pos", "sitemap"))
    return both.groupBy("origin").agg(F.min_by("sitemap", F.struct("tier", "pos")).alias("sitemap"))


def index_links(indexes: DataFrame) -> DataFrame:
    """(url, pos, target) of all Markdown link targets of link indexes, as seen from the index's origin."""
    rows = indexes.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("pos", "link"))
    return rows.select("url", "pos", urls.resolve(F.col("link"), F.concat(urls.origin(F.col("url")), F.lit("/"))).alias("target"))


def repository_files(tree: DataFrame, cap: int) -> DataFrame:
    """README first, then Markdown files under a docs folder in tree order, ``cap`` of them at most per repository (0: no cap)."""
    lower = F.lower("path")
    readme = F.lower(F.col("path")).rlike(r"^readme(\.(md|mdx|rst|txt))?$")
    wanted = tree.where(readme | (lower.rlike(r"\.mdx?$") & (lower.startswith("docs/") | lower.contains("/docs/"))))
    place = Window.partitionBy("repo").orderBy(readme.desc(), "pos")
    return wanted.withColumn("rank", F.row_number().over(place)).where((F.col("rank") <= cap) | F.lit(cap == 0))


def raw_texts(captures: DataFrame) -> DataFrame:
    """Bodies stripped, titled by the last part of the path."""
    last = F.element_at(F.split(F.regexp_replace(urls.path(F.col("url")), "/$", ""), "/"), -1)
    return captures.select("url", F.coalesce(F.nullif(last, F.lit("")), F.col("url")).alias("title"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("markdown"))


def manifest_paths(files: DataFrame, depth: int = 3) -> DataFrame:
    """Rows of ``files`` (path, ...) that are manifests, ``depth`` folders deep at most, outside skipped and dot folders."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    fine = ~F.exists(folders, lambda p: p.isin(SKIPPED_FOLDERS) | p.startswith("."))
    return files.where(F.element_at(parts, -1).isin(MANIFESTS) & (F.size(folders) <= depth) & fine)


def read_manifests(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """``path, body`` of the manifests below a folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = F.regexp_replace(F.replace(F.col("_metadata.file_path"), F.lit(root.rstrip("/")), F.lit("")), r"^[a-z]*:?/*", "")
    return manifest_paths(files.select(path.alias("path"), F.col("value").alias("body")), depth)
