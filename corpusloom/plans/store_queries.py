"""Store listings, reads, sinks and aggregates (A, W, K, R1-R3, J1, J7, V) over the page store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import versions
from corpusloom.operators import store as s
from corpusloom.plans.fixtures import DOC_VERSIONS, KEY_SQL, STORE, doc_versions, store
from corpusloom.session import number_rows, shared_dir

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str, head: str = DOC_VERSIONS):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = f"WITH {head}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return fn

    return register


#: Where each session keeps the saved store of each data folder.
SAVED: dict[tuple[str, str], str] = {}


def saved(spark, d):
    """The store as ``save`` leaves it, written at the first use in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in SAVED:
        path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
        s.save(store(spark, d), path)
        SAVED[key] = path
    return spark.read.schema(f"{s.PAGE_SCHEMA}, characters long").parquet(SAVED[key])


SIZED = "+ sized AS (SELECT technology, version, count(*) AS pages, CAST(sum(length(content)) AS BIGINT) AS characters FROM store GROUP BY ALL)"
MERGED = "CASE WHEN count(*) FILTER (WHERE NOT complete) > 0 THEN false WHEN count(*) > count(complete) THEN NULL ELSE true END"
RECENT = f"struct_pack(k := {KEY_SQL}, h := harvested_at, v := version)"


@query("a1_technologies", f"""{SIZED} SELECT technology, count(*) AS versions, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(characters) AS BIGINT) AS characters,
  max_by(version, {RECENT}) AS latest, strftime(max(harvested_at), '%Y-%m-%d %H:%M') AS last_harvest, {MERGED} AS complete
  FROM doc_versions JOIN sized USING (technology, version) WHERE contains(lower(technology), 'src1') GROUP BY technology""")
def a1(spark, d):
    return s.technology_list(doc_versions(spark, d), store(spark, d), "SRC1")


@query("a1_saved_technologies", f"""{SIZED} SELECT technology, count(*) AS versions, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(characters) AS BIGINT) AS characters,
  max_by(version, {RECENT}) AS latest, strftime(max(harvested_at), '%Y-%m-%d %H:%M') AS last_harvest, {MERGED} AS complete
  FROM doc_versions JOIN sized USING (technology, version) GROUP BY technology""")
def a1_saved(spark, d):
    return s.technology_list(doc_versions(spark, d), saved(spark, d))


@query("k1_saved_ordinals", "SELECT technology, version, row_number() OVER (PARTITION BY technology, version ORDER BY ordinal, url) AS ordinal, url, length(content) AS characters FROM store", STORE)
def k1_saved(spark, d):
    return saved(spark, d).select("technology", "version", "ordinal", "url", "characters")


@query("s10_pruned_scan", """SELECT technology, version, ordinal, title, content FROM (
  SELECT *, row_number() OVER (PARTITION BY technology, version ORDER BY ordinal, url) AS number FROM store WHERE technology = 'src7' AND version IN ('1.9', 'latest'))""".replace("version, ordinal, title", "version, number AS ordinal, title"), STORE)
def s10(spark, d):
    return saved(spark, d).where("technology = 'src7' AND version IN ('1.9', 'latest')").select("technology", "version", "ordinal", "title", "content")


@query("a2_versions", f"{SIZED} SELECT technology, version, source, strategy, complete, expected, pages, characters FROM doc_versions JOIN sized USING (technology, version)")
def a2(spark, d):
    return s.version_list(doc_versions(spark, d), store(spark, d)).drop("harvested_at")


@query("a3_merged_completeness", f"SELECT version, {MERGED} AS complete FROM doc_versions GROUP BY version")
def a3(spark, d):
    return doc_versions(spark, d).groupBy("version").agg(s.merged_complete(F.col("complete")).alias("complete"))


@query("a4_newest_label", f"SELECT technology, max_by(version, {RECENT}) AS newest FROM doc_versions GROUP BY technology")
def a4(spark, d):
    return doc_versions(spark, d).groupBy("technology").agg(F.max_by("version", s.recency()).alias("newest"))


@query("a6_harvest_completeness", f"{SIZED} SELECT technology, version, CASE WHEN strategy = 'html' AND expected IS NULL THEN false WHEN strategy = 'sitemap' THEN pages >= expected ELSE complete END AS whole FROM doc_versions JOIN sized USING (technology, version)")
def a6(spark, d):
    rows = s.version_list(doc_versions(spark, d), store(spark, d))
    truncated = (F.col("strategy") == "html") & F.col("expected").isNull()
    return rows.select("technology", "version", F.when(truncated, False).when(F.col("strategy") == "sitemap", F.col("pages") >= F.col("expected")).otherwise(F.col("complete")).alias("whole"))


@query("a7_coverage_notes", f"{SIZED} SELECT technology, version, CASE WHEN complete THEN 'complete' WHEN NOT complete THEN 'partial' ELSE 'unknown' END AS flag, CASE WHEN expected > pages THEN pages || ' of ' || expected || ' pages' ELSE pages || ' pages' END AS note FROM doc_versions JOIN sized USING (technology, version)")
def a7(spark, d):
    return s.coverage(s.version_list(doc_versions(spark, d), store(spark, d)))


@query("a10_labels_by_time", "SELECT technology, array_to_string(list(version ORDER BY harvested_at DESC, version DESC), ',') AS labels FROM doc_versions GROUP BY technology")
def a10(spark, d):
    pair = F.sort_array(F.collect_list(F.struct("harvested_at", "version")), asc=False)
    return doc_versions(spark, d).groupBy("technology").agg(F.array_join(F.transform(pair, lambda p: p["version"]), ",").alias("labels"))


@query("a11_page_titles", "SELECT technology, version, array_to_string(list(title ORDER BY ordinal)[1:2000], chr(10)) AS titles FROM store GROUP BY ALL", STORE)
def a11(spark, d):
    return s.first_titles(store(spark, d))


@query("a12_contents_list", "+ n AS (SELECT *, row_number() OVER (PARTITION BY technology, version ORDER BY ordinal) AS n FROM store) SELECT technology, version, string_agg(n || '. ' || title, chr(10) ORDER BY n) AS contents FROM n GROUP BY ALL", STORE)
def a12(spark, d):
    return s.contents(store(spark, d))


@query("w1_ordinals", "SELECT technology, version, ordinal AS came, row_number() OVER (PARTITION BY technology, version ORDER BY ordinal) AS ordinal FROM store", STORE)
def w1(spark, d):
    return s.numbered(store(spark, d))


@query("w2_entry", f"+ r AS (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY {RECENT} DESC) AS rn FROM doc_versions) SELECT technology, version, source, strategy, complete, expected FROM r WHERE rn = 1")
def w2(spark, d):
    return s.entry(doc_versions(spark, d)).drop("harvested_at")


@query("w3_page_list", "SELECT technology, version, ordinal, title, url, length(content) AS characters FROM store", STORE)
def w3(spark, d):
    return store(spark, d).select("technology", "version", "ordinal", "title", "url", F.length("content").cast("long").alias("characters")).orderBy("technology", "version", "ordinal")


@query("w4_page_by_ordinal", "SELECT technology, version, title, url, content FROM store WHERE ordinal = 5", STORE)
def w4(spark, d):
    return store(spark, d).where("ordinal = 5").drop("ordinal")


@query("w5_pagination", "+ t AS (SELECT DISTINCT technology FROM store) SELECT technology, (SELECT count(*) FROM t) AS total FROM t ORDER BY technology LIMIT 12 OFFSET 12", STORE)
def w5(spark, d):
    names = store(spark, d).select("technology").distinct()
    return names.orderBy("technology").offset(12).limit(12).crossJoin(names.agg(F.count("*").alias("total")))


@query("r1_read_version", f"+ e AS (SELECT technology, max_by(version, {RECENT}) AS version FROM doc_versions GROUP BY technology) SELECT technology, version, sha256(string_agg(content, chr(10) ORDER BY ordinal)) AS text_sha256 FROM store JOIN e USING (technology, version) GROUP BY ALL")
def r1(spark, d):
    newest = s.entry(doc_versions(spark, d)).select("technology", "version")
    pages = store(spark, d).join(newest, ["technology", "version"], "left_semi")
    return s.text_digests(pages, "content", "\n")


@query("r2_read_section", """+ m AS (SELECT *, contains(lower(title), 'the of') AS t, contains(lower(content), 'the of') AS c FROM store),
  g AS (SELECT *, bool_or(t) OVER (PARTITION BY technology, version) AS any_t FROM m WHERE t OR c)
  SELECT technology, version, ordinal, title, url, CASE WHEN any_t THEN 'title' ELSE 'content' END AS matched FROM g WHERE t OR NOT any_t""", STORE)
def r2(spark, d):
    return s.read_section(store(spark, d), "The of")


@query("r3_substring_search", """+ h AS (SELECT *, greatest(instr(lower(content), 'licensed under') - 91, 0) AS begin_ FROM store WHERE contains(lower(title || chr(10) || url || chr(10) || content), 'licensed under') ORDER BY technology, version, ordinal LIMIT 25)
  SELECT technology, version, ordinal, title, url, CASE WHEN begin_ > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(content, begin_ + 1, 240), '\\s+', ' ', 'g')) || '…' AS snippet FROM h""", STORE)
def r3(spark, d):
    return s.substring_search(store(spark, d), "Licensed under", 25)


NEW = ", incoming AS (SELECT technology, version, ordinal, 'new ' || title AS title, url, content FROM store WHERE version = '2.11' AND ordinal % 2 = 0)"


@query("k1_replace_version", "SELECT * FROM store s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.technology = s.technology AND i.version = s.version) UNION ALL SELECT * FROM incoming", STORE + NEW)
def k1(spark, d):
    new = store(spark, d).where("version = '2.11' and ordinal % 2 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    return s.replace_versions(store(spark, d), new)


def targets(spark, d):
    """Every third source whole, the others' version 1.9."""
    names = store(spark, d).select("technology").distinct()
    return names.select("technology", F.when(F.length("technology") % 2 == 0, F.lit(None).cast("string")).otherwise("1.9").alias("version"))


TARGETS = ", targets AS (SELECT DISTINCT technology, CASE WHEN length(technology) % 2 = 0 THEN NULL ELSE '1.9' END AS version FROM store)"


@query("k2_delete", "SELECT s.* FROM store s WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.technology = s.technology AND (t.version IS NULL OR t.version = s.version))", STORE + TARGETS)
def k2(spark, d):
    return s.delete(store(spark, d), targets(spark, d))


@query("k3_delete_preview", f"{SIZED} SELECT technology, count(*) FILTER (WHERE t.version IS NULL OR t.version = v.version) AS versions, CAST(coalesce(sum(pages) FILTER (WHERE t.version IS NULL OR t.version = v.version), 0) AS BIGINT) AS pages, CAST(coalesce(sum(characters) FILTER (WHERE t.version IS NULL OR t.version = v.version), 0) AS BIGINT) AS characters, count(*) FILTER (WHERE NOT (t.version IS NULL OR t.version = v.version)) AS remaining FROM (SELECT * FROM doc_versions JOIN sized USING (technology, version)) v JOIN targets t USING (technology) GROUP BY technology", DOC_VERSIONS + TARGETS)
def k3(spark, d):
    return s.delete_preview(doc_versions(spark, d), store(spark, d), targets(spark, d))


COMBINED = "'# ' || technology || ' ' || version || chr(10) || string_agg(chr(10) || '---' || chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || 'Source: <' || url || '>' || chr(10) || chr(10) || content || chr(10), '' ORDER BY ordinal)"


@query("k4_combined_export", f"SELECT technology, version, sha256({COMBINED}) AS text_sha256 FROM store GROUP BY technology, version", STORE)
def k4(spark, d):
    return s.combined_digests(store(spark, d))


#: Every third page has a stamp of its own, which the file leaves out.
STAMP = "<!-- source: x | type: html | scraped: y -->"


@query("k4_documentation_file", r"""+ n AS (SELECT *, row_number() OVER (PARTITION BY technology, version ORDER BY ordinal) AS n FROM store),
  t AS (SELECT technology, version, count(*) AS pages, string_agg(n || '. [' || title || '](' || url || ')' || chr(10), '' ORDER BY n) AS listing,
    string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || 'Source: <' || url || '>' || chr(10) || chr(10) || regexp_replace(content, '^\s+|\s+$', '', 'g') || chr(10), '' ORDER BY n) AS blocks FROM n GROUP BY ALL)
  SELECT technology, version, sha256('# ' || technology || '.example.dev documentation' || chr(10) || chr(10) || '<!-- harvested: ' || pages || ' pages | from: ' || source || ' | via: ' || strategy || ' | ' || strftime(harvested_at, '%Y-%m-%d %H:%M') || ' -->' || chr(10) || chr(10) || '## Contents' || chr(10) || chr(10) || listing || blocks) AS text_sha256
  FROM t JOIN doc_versions USING (technology, version)""")
def k4_file(spark, d):
    stamped = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit(STAMP + "\n\n"), "content")).otherwise(F.col("content"))
    return s.file_digests(store(spark, d).withColumn("content", stamped), doc_versions(spark, d))


@query("w4_pages_asked", """+ asked AS (SELECT technology, version, least(min(ordinal), 3) + g AS ordinal FROM store, (SELECT unnest([0, 1, 100000000]) AS g) GROUP BY technology, version, g)
  SELECT technology, version, ordinal, s.url IS NOT NULL AS found, CASE WHEN s.url IS NULL THEN technology || ' has no page ' || ordinal END AS reason, s.title, s.url, s.content FROM asked LEFT JOIN store s USING (technology, version, ordinal)""", STORE)
def w4_asked(spark, d):
    rows = store(spark, d)
    first = rows.groupBy("technology", "version").agg(F.least(F.min("ordinal"), F.lit(3)).alias("low"))
    asked = first.select("technology", "version", F.explode(F.array(*[F.col("low") + g for g in (0, 1, 100_000_000)])).alias("ordinal"))
    return s.pages_by_ordinal(rows, asked)


@query("s9_split_combined", "SELECT technology, version, row_number() OVER (PARTITION BY technology, version ORDER BY ordinal) AS ordinal, title, url, sha256(content) AS content_sha256 FROM store", STORE)
def s9(spark, d):
    return s.split_blocks(s.combined_blocks(store(spark, d))).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


QUERIES["k7_backfill"] = lambda spark, d: s.replace_versions(store(spark, d).where("version = '1.9'"), s.split_blocks(s.combined_blocks(store(spark, d).where("version <> '1.9'")))).groupBy("technology", "version").agg(F.count("*").alias("pages"), F.sum(F.length("content")).alias("characters"))
ORACLES["k7_backfill"] = f"WITH {STORE} SELECT technology, version, count(*) AS pages, CAST(sum(length(content)) AS BIGINT) AS characters FROM store GROUP BY ALL"


@query("k6_legacy_upgrade", r"""SELECT technology AS name, source, coalesce(list_filter(list_transform(string_split(source, '/'), lambda p: lower(p)), lambda p: regexp_full_match(p, 'v\d+(\.\d+)*|\d+(\.\d+)+|latest|stable|next|canary'))[1], strftime(harvested_at, '%Y-%m-%d')) AS version, complete FROM doc_versions""")
def k6(spark, d):
    from corpusloom.functions import urls

    old = doc_versions(spark, d).drop("version")
    return old.select(F.col("technology").alias("name"), "source", urls.version_of(F.col("source"), F.col("harvested_at")).alias("version"), "complete")


# all pages; each technology also has a version that no page has
UNSTORED = ", asked AS (SELECT technology, version FROM doc_versions UNION ALL SELECT DISTINCT technology, 'unreleased' FROM doc_versions)"


@query("j1_versions_with_pages", f"{UNSTORED} SELECT v.technology, v.version, count(s.ordinal) AS pages FROM asked v LEFT JOIN store s ON s.technology = v.technology AND s.version = v.version GROUP BY ALL")
def j1(spark, d):
    known = doc_versions(spark, d).select("technology", "version")
    asked = known.union(known.select("technology", F.lit("unreleased")).distinct())
    # counted before the join, so that no group grows with its version
    sizes = store(spark, d).groupBy("technology", "version").agg(F.count("ordinal").alias("pages"))
    return asked.join(sizes, ["technology", "version"], "left").select("technology", "version", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("j7_requested_versions", "SELECT s.technology, s.version, s.ordinal, s.title FROM store s WHERE EXISTS (SELECT 1 FROM targets t WHERE t.technology = s.technology AND (t.version IS NULL OR t.version = s.version))", STORE + TARGETS)
def j7(spark, d):
    asked = F.col("t.version").isNull() | (F.col("s.version") == F.col("t.version"))
    return store(spark, d).alias("s").join(targets(spark, d).alias("t"), (F.col("s.technology") == F.col("t.technology")) & asked, "left_semi").select("technology", "version", "ordinal", "title")


@query("u9_checked_label", "SELECT technology, version AS claimed, CASE WHEN 2 * count(*) FILTER (WHERE contains(url, '/' || version || '/') AND ordinal % 3 <> 0) >= count(*) THEN version ELSE '2026-08-20' END AS label FROM store GROUP BY technology, version", STORE)
def u9(spark, d):
    agrees = F.count_if(F.contains("url", F.concat(F.lit("/"), F.col("version"), F.lit("/"))) & (F.col("ordinal") % 3 != 0))
    return store(spark, d).groupBy("technology", F.col("version").alias("claimed")).agg((2 * agrees >= F.count("*")).alias("agree")).select("technology", "claimed", F.when(F.col("agree"), F.col("claimed")).otherwise("2026-08-20").alias("label"))


LABEL_ROWS = """labels_ AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || (p_partkey % 12) WHEN 1 THEN 'v' || p_size WHEN 2 THEN p_size || '.0-rc' || (p_partkey % 3)
  WHEN 3 THEN '2026-0' || (p_partkey % 9 + 1) || '-11' WHEN 4 THEN split_part(p_name, ' ', 1) ELSE p_size || '.0.0' END AS version FROM part)"""


def labels(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda c: c.cast("string")
    label = (
        F.when(k % 6 == 0, F.concat(size, F.lit("."), text(k % 12)))
        .when(k % 6 == 1, F.concat(F.lit("v"), size))
        .when(k % 6 == 2, F.concat(size, F.lit(".0-rc"), text(k % 3)))
        .when(k % 6 == 3, F.concat(F.lit("2026-0"), text(k % 9 + 1), F.lit("-11")))
        .when(k % 6 == 4, F.split_part("p_name", F.lit(" "), F.lit(1)))
        .otherwise(F.concat(size, F.lit(".0.0")))
    )
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), label.alias("version"))


@query("v1_label_keys", f"SELECT id, k.kind AS kind, array_to_string(k.parts, '.') AS parts, k.is_final AS is_final, k.suffix AS suffix FROM (SELECT id, {KEY_SQL} AS k FROM labels_)", LABEL_ROWS)
def v1(spark, d):
    key = labels(spark, d).select("id", versions.sort_key(F.col("version")).alias("k"))
    return key.select("id", "k.kind", F.array_join("k.parts", ".").alias("parts"), "k.is_final", "k.suffix")


@query("v2_v3_ordered_labels", f"SELECT version, CAST(dense_rank() OVER (ORDER BY {KEY_SQL} DESC) AS INTEGER) AS place, CASE WHEN regexp_full_match(version, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'harvest date' WHEN regexp_matches(version, '^[vV]?\\d') THEN 'release number' ELSE 'unrecognised label' END AS why FROM (SELECT DISTINCT version FROM labels_)", LABEL_ROWS)
def v2(spark, d):
    distinct = labels(spark, d).select("version").distinct()
    keys = number_rows(distinct.select(versions.sort_key(F.col("version")).alias("k")).distinct(), [], [F.desc("k")])
    keys = keys.select("k", (F.col("number") + 1).cast("int").alias("place"))
    return distinct.withColumn("k", versions.sort_key(F.col("version"))).join(keys, "k").select("version", "place", versions.why(F.col("version")).alias("why"))
