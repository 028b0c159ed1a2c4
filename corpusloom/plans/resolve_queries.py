"""Names, candidates and resolution (N, S12, S13, W6, W7, W10, J3, J6, A13) over registries made of parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import names, urls
from corpusloom.operators import resolve as r
from corpusloom.plans.fixtures import table

QUERIES, ORACLES = {}, {}
#: A name is a part's name and number, dressed in one of six ways; its slug is the plain form.
SLUG = "replace(p_name, ' ', '-') || '-' || p_partkey"
NAMES = f"named AS (SELECT p_partkey AS id, p_size AS size, {SLUG} AS slug, CASE p_partkey % 6 WHEN 0 THEN '@scope/' || {SLUG} WHEN 1 THEN upper({SLUG}) || '.js' WHEN 2 THEN {SLUG} || '-rs' WHEN 3 THEN '  ' || p_name || '_' || p_partkey WHEN 4 THEN {SLUG} || '.py' ELSE {SLUG} END AS name FROM part)"


def query(name: str, sql: str | None, head: str = NAMES):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = f"WITH {head}{', ' + sql[1:] if sql[0] == '+' else ' ' + sql}"
        return fn

    return register


def named(spark, d):
    k = F.col("p_partkey")
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string"))
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("@scope/"), slug))
        .when(k % 6 == 1, F.concat(F.upper(slug), F.lit(".js")))
        .when(k % 6 == 2, F.concat(slug, F.lit("-rs")))
        .when(k % 6 == 3, F.concat(F.lit("  "), "p_name", F.lit("_"), k.cast("string")))
        .when(k % 6 == 4, F.concat(slug, F.lit(".py")))
        .otherwise(slug)
    )
    return table(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("size"), slug.alias("slug"), name.alias("name"))


@query("n1_n2_names", "SELECT id, slug AS normalised, CASE id % 6 WHEN 0 THEN 'npm' WHEN 2 THEN 'crates' ELSE '' END AS ecosystem FROM named")
def n1(spark, d):
    return named(spark, d).select("id", names.normalise(F.col("name")).alias("normalised"), names.ecosystem(F.col("name")).alias("ecosystem"))


SCORED = "scored AS (SELECT id, CASE id % 5 WHEN 0 THEN 'https://github.com/o/' || slug WHEN 1 THEN 'https://docs.' || slug || '.io/' WHEN 2 THEN 'https://' || slug || '.com/guide/x' WHEN 3 THEN 'https://' || slug || '.com' ELSE '' END AS url, CASE id % 3 WHEN 0 THEN 'documentation' WHEN 1 THEN 'homepage' ELSE 'repository' END AS field FROM named)"


def candidate_url(i, slug):
    return F.when(i == 0, F.concat(F.lit("https://github.com/o/"), slug)).when(i == 1, F.concat(F.lit("https://docs."), slug, F.lit(".io/"))).when(i == 2, F.concat(F.lit("https://"), slug, F.lit(".com/guide/x"))).when(i == 3, F.concat(F.lit("https://"), slug, F.lit(".com"))).otherwise("")


def field_of(i):
    return F.when(i == 0, "documentation").when(i == 1, "homepage").otherwise("repository")


@query("n3_candidate_score", "SELECT id, CAST(CASE WHEN url = '' THEN 0 WHEN id % 5 = 0 THEN 0.35 WHEN field = 'documentation' THEN 0.92 WHEN field = 'homepage' THEN CASE WHEN id % 5 IN (1, 2) THEN 0.78 ELSE 0.55 END ELSE 0.35 END AS DOUBLE) AS score FROM scored", NAMES + ", " + SCORED)
def n3(spark, d):
    return named(spark, d).select("id", names.score(candidate_url(F.col("id") % 5, F.col("slug")), field_of(F.col("id") % 3)).alias("score"))


@query("j3_alias", "SELECT name AS asked, slug AS technology FROM named")
def j3(spark, d):
    n = named(spark, d)
    return r.alias(n.select(F.col("name").alias("asked")), n.select(F.col("slug").alias("technology")))


@query("j3_alias_prefix", "+cut AS (SELECT DISTINCT left(slug, 6) AS asked FROM named), n AS (SELECT asked, count(DISTINCT slug) AS n, min(slug) AS one FROM cut JOIN named ON starts_with(slug, asked) GROUP BY asked) SELECT asked, CASE WHEN n = 1 THEN one END AS technology FROM n WHERE NOT asked LIKE '%-'")
def j3p(spark, d):
    n = named(spark, d)
    return r.alias(n.select(F.left("slug", F.lit(6)).alias("asked")).where("asked not like '%-'"), n.select(F.col("slug").alias("technology")))


@query("n14_still_unknown", "SELECT name FROM named a WHERE id % 2 = 1 AND (SELECT count(*) FROM named b WHERE b.id % 2 = 0 AND starts_with(b.slug, a.slug)) <> 1")
def n14(spark, d):
    n = named(spark, d)
    known = r.alias(n.select(F.col("name").alias("asked")), n.where("id % 2 = 0").select(F.col("slug").alias("technology")))
    return r.joined(n.select("name"), known.where("technology is not null").select(F.col("asked").alias("name")), "name", "left_anti")


def payloads(spark, d):
    """A registry answer for each part: npm, PyPI and crates by turns."""
    n = named(spark, d)
    u = lambda host: F.concat(F.lit(f"https://{host}"), "slug")
    npm = F.to_json(F.struct(u("home.example.com/").alias("homepage"), F.struct(F.concat(F.lit("git+https://github.com/o/"), "slug", F.lit(".git")).alias("url")).alias("repository")))
    labels = F.create_map(F.lit("Documentation"), u("docs.example.com/"), F.lit("Homepage"), u("home.example.com/"), F.lit("Source Code"), u("github.com/o/"), F.lit("Funding"), u("pay.example.com/"))
    pypi = F.to_json(F.struct(F.struct(labels.alias("project_urls"), u("old.example.com/").alias("home_page")).alias("info")))
    crates = F.to_json(F.struct(F.struct(u("docs.rs/").alias("documentation"), F.lit("none").alias("homepage"), u("github.com/o/").alias("repository")).alias("crate")))
    k = F.col("id") % 3
    return n.select(F.col("slug").alias("name"), F.when(k == 0, "npm").when(k == 1, "pypi").otherwise("crates").alias("ecosystem"), F.when(k == 0, npm).when(k == 1, pypi).otherwise(crates).alias("payload"))


PAYLOADS = """declared AS (SELECT id, slug AS name, 'npm' AS ecosystem, 0 AS pos, 'npm:homepage' AS source, 'homepage' AS field, 'https://home.example.com/' || slug AS url FROM named WHERE id % 3 = 0
  UNION ALL SELECT id, slug, 'npm', 1, 'npm:repository', 'repository', 'https://github.com/o/' || slug FROM named WHERE id % 3 = 0
  UNION ALL SELECT id, slug, 'pypi', 0, 'pypi:Documentation', 'documentation', 'https://docs.example.com/' || slug FROM named WHERE id % 3 = 1
  UNION ALL SELECT id, slug, 'pypi', 1, 'pypi:Homepage', 'homepage', 'https://home.example.com/' || slug FROM named WHERE id % 3 = 1
  UNION ALL SELECT id, slug, 'pypi', 2, 'pypi:Source Code', 'repository', 'https://github.com/o/' || slug FROM named WHERE id % 3 = 1
  UNION ALL SELECT id, slug, 'pypi', 4, 'pypi:home_page', 'homepage', 'https://old.example.com/' || slug FROM named WHERE id % 3 = 1
  UNION ALL SELECT id, slug, 'crates', 0, 'crates:documentation', 'documentation', 'https://docs.rs/' || slug FROM named WHERE id % 3 = 2
  UNION ALL SELECT id, slug, 'crates', 2, 'crates:repository', 'repository', 'https://github.com/o/' || slug FROM named WHERE id % 3 = 2)"""


@query("s12_registry_candidates", "SELECT name, ecosystem, CAST(pos AS INTEGER) AS pos, source, field, url FROM declared", NAMES + ", " + PAYLOADS)
def s12(spark, d):
    return r.registry_candidates(payloads(spark, d))


@query("n12_registry_facts", "SELECT slug AS name, 'https://github.com/o/' || slug AS repository, CASE WHEN id % 3 < 2 THEN 'https://home.example.com/' || slug END AS homepage FROM named")
def n12(spark, d):
    return r.registry_facts(r.registry_candidates(payloads(spark, d)))


@query("s13_registry_order", "SELECT slug AS name, CASE id % 4 WHEN 3 THEN 'crates' ELSE 'npm' END AS first, CASE id % 4 WHEN 3 THEN 1 ELSE 2 END AS answers FROM named")
def s13(spark, d):
    n = named(spark, d).select(F.col("slug").alias("name"), F.when(F.col("id") % 4 == 3, "crates").otherwise("").alias("hint"), F.explode(F.array(F.lit("crates"), F.lit("npm"))).alias("ecosystem"))
    return r.registry_order(n, ["npm", "pypi", "crates"])


def bodies(spark, d):
    """A candidate page for each name: the name as often as the part's size, an install line, a repository link."""
    n = named(spark, d)
    k, slug = F.col("id"), F.col("slug")
    install = F.when(k % 4 == 0, F.concat(F.lit(" npm install "), slug)).when(k % 4 == 1, F.concat(F.lit(" cargo add "), slug)).otherwise("")
    link = F.when(k % 3 == 0, F.concat(F.lit(' <a href="https://github.com/o/'), slug, F.lit('/x">src</a>'))).otherwise("")
    body = F.concat(F.lit("<p>"), F.repeat(F.concat(slug, F.lit(" ")), (F.col("size") % 6).cast("int")), F.lit("</p>"), install, link)
    url = F.when(k % 5 == 0, F.concat(F.lit("https://docs."), slug, F.lit(".dev/x"))).when(k % 5 == 1, F.concat(F.lit("https://"), slug, F.lit(".org/"))).otherwise(F.concat(F.lit("https://other.example.com/"), slug))
    return n.select("id", slug.alias("name"), url.alias("url"), body.alias("body"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("https://github.com/o/"), slug).alias("repository"), F.when(k % 7 == 0, F.lit("https://other.example.com/home")).alias("homepage"), (k % 11 == 0).alias("via_domain"))


BODIES = """said AS (SELECT id, size, slug, id % 4 = 0 AS npm, id % 4 = 1 AS cargo, id % 3 = 0 AS link, id % 11 = 0 OR id % 5 IN (0, 1) AS own, id % 5 = 0 AS docs, id % 7 = 0 AND id % 5 > 1 AS agree,
  size % 6 + CASE WHEN id % 4 < 2 THEN 1 ELSE 0 END AS hits FROM named),
signed AS (SELECT *, list_filter([CASE WHEN own THEN 'own-domain' END, CASE WHEN docs THEN 'docs-host' END, CASE WHEN npm THEN 'install:npm' WHEN cargo THEN 'install-mismatch:crates' END,
  CASE WHEN link THEN 'repo-backlink' END, CASE WHEN agree THEN 'registry-agreement' END, CASE WHEN hits >= 3 THEN 'names-it:' || hits END], lambda s: s IS NOT NULL) AS signals,
  own::INT + docs::INT + npm::INT + link::INT + agree::INT AS strong FROM said),
judged AS (SELECT *, CASE WHEN cargo AND strong < 2 THEN false ELSE strong >= 2 OR (strong = 1 AND hits >= 3) END AS verified FROM signed)"""


@query("n9_n11_identity", "SELECT id, array_to_string(signals, ', ') AS signals, verified, CASE WHEN verified THEN 'known by ' || array_to_string(signals, ', ') WHEN len(signals) > 0 THEN 'too little: ' || array_to_string(signals, ', ') ELSE 'no sign of it on the page' END AS reason FROM judged", NAMES + ", " + BODIES)
def n9(spark, d):
    rows = r.signals(bodies(spark, d))
    return rows.select("id", F.array_join("signals", ", ").alias("signals"), "verified", r.reason(F.col("signals"), F.col("verified")).alias("reason"))


@query("j6_repository_backlink", "SELECT id FROM named WHERE id % 3 = 0")
def j6(spark, d):
    declared = bodies(spark, d).select("name", F.lower(urls.path(F.col("repository"))).alias("path"))
    return r.joined(bodies(spark, d), declared, "name").where(F.contains(F.lower("body"), F.substring(F.col("path"), F.lit(2), F.length("path")))).select("id")


@query("n6_n8_software_gate", "SELECT id, CASE id % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'crates' ELSE '' END AS ecosystem, CASE WHEN id % 4 < 2 THEN 'how to install it' WHEN id % 3 = 0 THEN 'where its source lives' ELSE '' END AS why, CASE WHEN id % 2 = 0 THEN 5 ELSE 2 END + CASE WHEN id % 4 < 2 THEN 2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS score FROM named")
def n6(spark, d):
    b = bodies(spark, d)
    plain = F.regexp_replace("body", r"<[^>]+>", " ")
    landed = F.concat(F.lit("https://else.example.com/"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("x"))
    score = r.domain_score(F.concat(F.lit("https://"), "name", F.lit(".dev")), landed, F.col("body"), F.col("name"))
    return b.select("id", r.install_line(plain, F.col("name")).alias("ecosystem"), r.looks_like_software(F.col("body"), F.col("name")).alias("why"), score.alias("score"))


def site_captures(spark, d):
    """Conventional paths and own domains that were captured, by the part's number."""
    n = named(spark, d)
    origin = F.concat(F.lit("https://"), "slug", F.lit(".io"))
    text = F.concat(F.lit("<html><pre>a</pre><pre>b</pre><code>c</code> "), F.repeat(F.lit("word "), 60), F.lit("</html>"))
    paths = n.select("id", "slug", origin.alias("origin"), F.explode(F.array(F.when(F.col("id") % 2 == 0, F.lit("/llms.txt")), F.lit("/docs/"), F.when(F.col("id") % 3 == 0, F.lit("/guide/")))).alias("path")).where("path is not null")
    html = F.when(F.col("path") == "/llms.txt", "text/plain").otherwise("text/html")
    body = F.when((F.col("path") == "/docs/") & (F.col("id") % 5 == 0), "<html>short</html>").otherwise(text)
    return paths.select(F.concat("origin", "path").alias("url"), F.lit(200).alias("status"), html.alias("content_type"), body.alias("body"))


@query("n4_probe_candidates", "SELECT 'https://' || slug || '.io' AS origin, 'https://' || slug || '.io' || path AS url, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, '/llms.txt' AS path, 0.95 AS confidence FROM named WHERE id % 2 = 0 UNION ALL SELECT *, '/docs/', 0.7 FROM named WHERE id % 2 = 1 AND id % 5 <> 0 UNION ALL SELECT *, '/guide/', 0.7 FROM named WHERE id % 2 = 1 AND id % 3 = 0)")
def n4(spark, d):
    return r.probe_candidates(named(spark, d).select(F.concat(F.lit("https://"), "slug", F.lit(".io")).alias("origin")), site_captures(spark, d))


@query("n5_n7_w10_own_domains", "SELECT slug AS name, 'https://' || CASE WHEN tld = 'io' THEN 'docs.example.com/' || slug ELSE slug || '.' || tld || '/' END AS url, tld, 'code to read' AS why, CASE WHEN tld = 'io' THEN 5 ELSE 0 END AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT slug, unnest(CASE WHEN id % 3 = 0 THEN ['io', 'org'] ELSE ['org', 'dev'] END) AS tld, unnest([1, 2]) AS rank FROM named WHERE id % 4 <> 0)")
def n5(spark, d):
    n = named(spark, d)
    tld = F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("dev"), F.lit("io"), F.lit("org"))).otherwise(F.array(F.lit("dev"), F.lit("org"), F.lit("dev2"))))
    rows = n.where("id % 4 <> 0").select("id", "slug", tld.alias("tld"))
    body = F.concat(F.lit("<pre>a</pre><pre>b</pre><code>c</code> "), F.repeat(F.lit("word "), 60))
    origin = F.concat(F.lit("https://"), "slug", F.lit("."), "tld")
    landed = F.when(F.col("tld") == "io", F.concat(F.lit("https://docs.example.com/"), "slug")).otherwise(F.concat(origin, F.lit("/")))
    captured = rows.select(origin.alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), landed.alias("landed"), body.alias("body"))
    return r.domain_candidates(n.select(F.col("slug").alias("name")), captured)


CANDIDATES = """cands AS (SELECT id, slug AS name, 'https://c' || j || '.example.com/' || slug || CASE WHEN j % 2 = 0 THEN '/' ELSE '' END AS url, CASE WHEN j = 7 THEN 'domain:dev' ELSE 'npm:' || j END AS source, ((id * 7 + j * 3) % 10) / 10.0::DOUBLE AS confidence, (id + j) % 5 = 0 AS verified FROM named, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS j)
  UNION ALL SELECT id, slug, 'https://c0.example.com/' || slug, 'npm:x', 0.05::DOUBLE, false FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, source, url) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name, rtrim(url, '/') ORDER BY confidence DESC, source, url) AS nth FROM cands) WHERE nth = 1)"""


def cands(spark, d):
    n = named(spark, d).select("id", F.col("slug").alias("name"))
    j = F.col("j")
    rows = n.select("id", "name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    url = F.concat(F.lit("https://c"), j.cast("string"), F.lit(".example.com/"), "name", F.when(j % 2 == 0, "/").otherwise(""))
    source = F.when(j == 7, "domain:dev").otherwise(F.concat(F.lit("npm:"), j.cast("string")))
    rows = rows.select("id", "name", url.alias("url"), source.alias("source"), (((F.col("id") * 7 + j * 3) % 10) / 10.0).alias("confidence"), ((F.col("id") + j) % 5 == 0).alias("verified"))
    return rows.union(n.select("id", "name", F.concat(F.lit("https://c0.example.com/"), "name"), F.lit("npm:x"), F.lit(0.05), F.lit(False)))


@query("w6_top_candidates", "SELECT name, url, source, confidence, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 6", NAMES + ", " + CANDIDATES)
def w6(spark, d):
    return r.top_candidates(cands(spark, d)).select("name", "url", "source", "confidence", "rank")


@query("w7_best_verified", "SELECT name, min_by(url, rank) FILTER (WHERE verified) AS best, count(*) AS candidates FROM ranked WHERE rank <= 6 GROUP BY name", NAMES + ", " + CANDIDATES)
def w7(spark, d):
    return r.best_verified(r.top_candidates(cands(spark, d)))


def resolved_sql(ranked: str, within: str) -> str:
    return f"""done AS (SELECT DISTINCT name FROM cands WHERE source LIKE 'domain:%' AND verified),
pool AS (SELECT *, CASE WHEN source LIKE 'domain:%' THEN 'domain' ELSE 'registry' END AS via FROM cands c WHERE name NOT IN (SELECT name FROM done) OR source LIKE 'domain:%'),
{ranked} AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, source, url) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name, rtrim(url, '/') ORDER BY confidence DESC, source, url) AS nth FROM pool) WHERE nth = 1),
answers AS (SELECT name, min_by(url, rank) FILTER (WHERE verified) AS best, coalesce(min_by(via, rank) FILTER (WHERE verified), 'unresolved') AS via, count(*) AS candidates FROM {ranked}{within} GROUP BY name)"""


def batch(spark, d, most=None):
    c = cands(spark, d).drop("id")
    domain = F.col("source").startswith("domain:")
    return r.resolve(c.where(domain), c.where(~domain), most)


@query("n13_batch_resolution", "SELECT * FROM answers", NAMES + ", " + CANDIDATES + ", " + resolved_sql("placed", ""))
def n13(spark, d):
    return batch(spark, d)


def web(spark, d):
    """What was captured for the chain, by the part's number modulo 8: see CHAIN."""
    n = named(spark, d)
    k, slug = F.col("id") % 8, F.col("slug")
    page = lambda more: F.concat(F.lit("<html><pre>a</pre><pre>b</pre><code>c</code> "), F.repeat(F.lit("word "), 60), *more, F.lit("</html>"))
    npm, thrice = page([F.lit("npm install "), slug]), F.repeat(F.concat(slug, F.lit(" ")), 4)
    backed = page([F.lit("pip install "), slug, F.lit(' <a href="https://github.com/o/'), slug, F.lit('">src</a>')])
    one = lambda url, kind, body: F.struct(url.alias("url"), F.lit(kind).alias("content_type"), url.alias("landed"), body.alias("body"))
    at = lambda before, after: F.concat(F.lit(before), slug, F.lit(after))
    own = one(at("https://", ".dev"), "text/html; charset=utf-8", npm)
    home = one(at("https://home.", ".example.net/"), "text/html", npm)
    pages = (
        F.when(k == 0, F.array(own, one(at("https://", ".dev/llms.txt"), "text/plain", thrice)))
        .when(k == 4, F.array(own))
        .when(k == 1, F.array(home))
        .when(k == 5, F.array(home, one(at("https://home.", ".example.net/docs/"), "text/html", npm)))
        .when(k.isin(2, 6), F.array(one(at("https://manual.example.org/", "/book"), "text/html", backed)))
        .when(k == 3, F.array(one(at("https://plain.example.com/", ""), "text/html", page([F.lit("")]))))
    )
    return n.select(F.explode(pages).alias("p")).select("p.url", F.lit(200).alias("status"), "p.content_type", "p.landed", "p.body")


def answered(spark, d):
    """Registry answers of the chain: 1 and 5 npm, 2 and 6 npm and PyPI, 3 npm, the others none."""
    n = named(spark, d)
    k, slug = F.col("id") % 8, F.col("slug")
    at = lambda before, after: F.concat(F.lit(before), slug, F.lit(after))
    home = F.when(k.isin(1, 5), at("https://home.", ".example.net/")).when(k == 3, at("https://plain.example.com/", "")).otherwise(at("https://manual.example.org/", "/shop"))
    npm = F.to_json(F.struct(home.alias("homepage"), F.struct(at("git+https://github.com/o/", ".git").alias("url")).alias("repository")))
    pypi = F.to_json(F.struct(F.struct(F.create_map(F.lit("Documentation"), at("https://manual.example.org/", "/book")).alias("project_urls")).alias("info")))
    one = lambda ecosystem, payload: F.struct(F.lit(ecosystem).alias("ecosystem"), payload.alias("payload"))
    given = F.when(k.isin(2, 6), F.array(one("npm", npm), one("pypi", pypi))).when(k.isin(1, 3, 5), F.array(one("npm", npm)))
    return n.select(slug.alias("name"), F.explode(given).alias("g")).select("name", "g.ecosystem", "g.payload")


#: Own domain with a text index; npm homepage; PyPI's manual behind npm's; nothing on the page; own domain; homepage
#: with documentation under it; the manual of a hinted name, whose registry declares nothing else: too little; no answer at all.
CHAIN = """SELECT slug AS name, CASE id % 8 WHEN 0 THEN 'https://' || slug || '.dev/llms.txt' WHEN 1 THEN 'https://home.' || slug || '.example.net/' WHEN 4 THEN 'https://' || slug || '.dev'
  WHEN 5 THEN 'https://home.' || slug || '.example.net/docs/' WHEN 2 THEN 'https://manual.example.org/' || slug || '/book' END AS best,
  CASE WHEN id % 8 IN (0, 4) THEN 'domain' WHEN id % 8 IN (1, 2, 5) THEN 'registry' ELSE 'unresolved' END AS via,
  CASE WHEN id % 8 IN (1, 3, 5) THEN 'npm' WHEN id % 8 IN (2, 6) THEN 'pypi' ELSE '' END AS ecosystem,
  CASE id % 8 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 1 ELSE 0 END AS candidates FROM named"""


@query("n13_o3_resolution_chain", CHAIN)
def n13_chain(spark, d):
    wanted = named(spark, d).select(F.col("slug").alias("name"), F.when(F.col("id") % 8 == 6, "pypi").otherwise("").alias("hint"))
    return r.resolve_names(wanted, r.registry_candidates(answered(spark, d)), web(spark, d))


@query("a13_accuracy", "SELECT count(*) FILTER (WHERE split_part(best, '/', 3) = 'c' || (length(name) % 8) || '.example.com') AS correct, count(*) FILTER (WHERE split_part(best, '/', 3) <> 'c' || (length(name) % 8) || '.example.com') AS wrong, count(*) FILTER (WHERE best IS NULL) AS unresolved, count(*) FILTER (WHERE split_part(best, '/', 3) <> 'c' || (length(name) % 8) || '.example.com') AS wrong_verified FROM answers", NAMES + ", " + CANDIDATES + ", " + resolved_sql("top6", " WHERE rank <= 6"))
def a13(spark, d):
    found = batch(spark, d, r.MOST).withColumn("verified", F.col("best").isNotNull())
    return r.accuracy(found, found.select("name", F.concat(F.lit("c"), (F.length("name") % 8).cast("string"), F.lit(".example.com")).alias("host")))
