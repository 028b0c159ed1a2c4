"""Batch resolution of technology names: candidates, identity signals, verdicts and the best verified answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import names, text, urls
from corpusloom.session import materialise

# Conventional documentation paths, domains of a name, install commands by ecosystem.
DOC_PATHS = ["/llms.txt", "/docs/", "/docs", "/documentation/", "/guide/", "/en/latest/", "/latest/"]
TLDS = ["dev", "io", "org", "com"]
INSTALL = [
    ("npm", r"(?:npm|pnpm|bun)\s+(?:i|add|install|create)\s+(?:-\w+\s+)*"),
    ("npm", r"yarn\s+add\s+"),
    ("pypi", r"(?:pip|pip3|uv pip|poetry add|conda install)\s+(?:install\s+)?"),
    ("crates", r"cargo\s+add\s+"),
    ("go", r"go\s+get\s+(?:[\w.\-/]+/)?"),
]
STRONG = r"^(own-domain|docs-host|install:|repo-backlink|registry-agreement)"
FORGE_LINK = r"(?i)https?://(?:www\.)?(?:github|gitlab|bitbucket)\.com/[\w.\-]+/"
REGISTRIES = ["npm", "pypi", "crates"]
MIN_TEXT, WINDOW, MOST = 200, 40_000, 6


def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle and sort: sizes of exploded rows and of bodies are guessed far too low, and a broadcast goes through the driver."""
    return left.join(right.hint("merge"), on, how)


def install_line(body: Column, slug: Column) -> Column:
    """The ecosystem of the first install command that names the slug, else ''."""
    out = F.lit("")
    quoted = F.concat(F.lit(r"\Q"), slug, F.lit(r"\E"))
    for eco, prefix in reversed(INSTALL):
        pattern = F.concat(F.lit(r"(?i)" + prefix + r"[\"'@\w./\-]*\b"), quoted, F.lit(r"\b"))
        out = F.when(F.regexp_like(body, pattern), eco).otherwise(out)
    return out


def looks_like_software(body: Column, slug: Column) -> Column:
    """Why a page seems to be a software project's, else ''."""
    plain = F.regexp_replace(body, r"<[^>]+>", " ")
    return (
        F.when(install_line(plain, slug) != "", "how to install it")
        .when(body.rlike(FORGE_LINK), "where its source lives")
        .when(F.regexp_count(body, F.lit(r"(?i)<(?:code|pre)[\s>]")) >= 3, "code to read")
        .otherwise("")
    )


def domain_score(origin: Column, landed: Column, body: Column, slug: Column) -> Column:
    moved = urls.bare_host(landed) != urls.bare_host(origin)
    plain = F.regexp_replace(body, r"<[^>]+>", " ")
    return F.when(moved, 2).otherwise(0) + F.when(moved & F.contains(F.lower(urls.path(landed)), slug), 3).otherwise(0) + F.when(install_line(plain, slug) != "", 2).otherwise(0) + F.when(body.rlike(FORGE_LINK), 1).otherwise(0)


def signals(rows: DataFrame) -> DataFrame:
    """``rows`` (name, url, body; ecosystem, repository, homepage as the registries declare them, via_domain) with
    ``signals`` and ``verified``."""
    body = F.left(F.coalesce("body", F.lit("")), F.lit(WINDOW))
    slug = names.normalise(F.col("name"))
    rows = rows.withColumn("slug", slug).withColumn("plain", F.regexp_replace(body, r"<[^>]+>", " "))
    url, slug, plain = F.col("url"), F.col("slug"), F.col("plain")
    owns = urls.owns_name(url, slug) & (slug != "")
    eco = install_line(plain, slug)
    wanted = F.coalesce("ecosystem", F.lit(""))
    install = F.when(eco != "", F.concat(F.when((wanted == "") | (wanted == eco), "install:").otherwise("install-mismatch:"), eco))
    repo = F.regexp_replace(F.coalesce("repository", F.lit("")), "/+$", "")
    repo_path = F.lower(F.regexp_replace(urls.path(repo), "^/+|/+$", ""))
    backlink = (repo_path != "") & F.contains(F.lower(body), repo_path) & (F.regexp_replace(url, "/+$", "") != repo)
    home = urls.bare_host(F.coalesce("homepage", F.lit("")))
    hits = F.when(slug == "", 0).otherwise(text.occurrences(names.normalise(plain), slug))
    found = F.array(
        F.when(F.col("via_domain") | owns, "own-domain"),
        F.when(owns & urls.is_docs_host(url), "docs-host"),
        install,
        F.when(backlink, "repo-backlink"),
        F.when((home != "") & (home == urls.bare_host(url)), "registry-agreement"),
        F.when(hits >= 3, F.concat(F.lit("names-it:"), hits.cast("string"))),
    )
    out = rows.withColumn("signals", F.array_compact(found)).drop("plain")
    return out.withColumn("verified", identified(F.col("signals")) & (F.col("slug") != ""))


def identified(found: Column) -> Column:
    """Two strong signals, or one and the name repeated; an install line of another ecosystem needs two."""
    strong = F.size(F.filter(found, lambda s: s.rlike(STRONG)))
    named = F.exists(found, lambda s: s.startswith("names-it"))
    mismatch = F.exists(found, lambda s: s.startswith("install-mismatch"))
    return F.when(mismatch & (strong < 2), False).otherwise((strong >= 2) | ((strong == 1) & named))


def reason(found: Column, verified: Column) -> Column:
    listed = F.array_join(found, ", ")
    return F.when(verified, F.concat(F.lit("known by "), listed)).when(F.size(found) > 0, F.concat(F.lit("too little: "), listed)).otherwise("no sign of it on the page")


def registry_candidates(payloads: DataFrame) -> DataFrame:
    """(name, ecosystem, url, source, field, pos) of registry payloads (name, ecosystem, payload as JSON)."""
    get = lambda path: F.trim(F.coalesce(F.get_json_object("payload", path), F.lit("")))
    npm_repo = F.coalesce(F.get_json_object("payload", "$.repository.url"), F.get_json_object("payload", "$.repository"))
    one = lambda source, field, url: F.struct(F.lit(source).alias("source"), F.lit(field).alias("field"), url.alias("url"))
    npm = F.array(one("npm:homepage", "homepage", get("$.homepage")), one("npm:repository", "repository", urls.clean_remote(npm_repo)))
    crates = F.array(*[one(f"crates:{k}", k, get(f"$.crate.{k}")) for k in ("documentation", "homepage", "repository")])
    label_urls = F.map_entries(F.from_json(F.get_json_object("payload", "$.info.project_urls"), "map<string,string>"))

    def labelled(e):
        low = F.lower(e["key"])
        field = F.when(low.contains("doc"), "documentation").when(low.contains("home"), "homepage").when(low.contains("source") | low.contains("repo"), "repository")
        return F.struct(F.concat(F.lit("pypi:"), e["key"]).alias("source"), field.alias("field"), e["value"].alias("url"))

    pypi = F.concat(F.coalesce(F.transform(label_urls, labelled), F.array().cast("array<struct<source:string,field:string,url:string>>")), F.array(one("pypi:home_page", "homepage", get("$.info.home_page"))))
    rows = payloads.select("name", "ecosystem", F.posexplode(F.when(F.col("ecosystem") == "npm", npm).when(F.col("ecosystem") == "crates", crates).otherwise(pypi)).alias("pos", "c"))
    return rows.where(F.col("c.url").startswith("http") & F.col("c.field").isNotNull()).select("name", "ecosystem", "pos", "c.source", "c.field", "c.url")


def registry_facts(candidates: DataFrame) -> DataFrame:
    """(name, repository, homepage): the first declared of each kind."""
    tail = F.lower(F.element_at(F.split("source", ":"), -1))
    repo = tail.contains("repo") | tail.contains("source")
    place = F.struct("ecosystem", "pos")
    return candidates.groupBy("name").agg(F.min_by(F.when(repo, F.col("url")), F.when(repo, place)).alias("repository"), F.min_by(F.when(~repo & tail.contains("home"), F.col("url")), F.when(~repo & tail.contains("home"), place)).alias("homepage"))


def registry_order(answers: DataFrame, order: list[str]) -> DataFrame:
    """Of answers (name, hint, ecosystem) those that count: the hinted registry's, else all; and which came first."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("ecosystem"))
    kept = answers.where((F.coalesce("hint", F.lit("")) == "") | (F.col("hint") == F.col("ecosystem")))
    return kept.groupBy("name").agg(F.min_by("ecosystem", rank).alias("first"), F.count("*").alias("answers"))


def probe_candidates(origins: DataFrame, captures: DataFrame) -> DataFrame:
    """(origin, url, confidence) of conventional paths that are captured; a text index ends the search there."""
    return probes(origins, captures).drop("pos")


def probes(origins: DataFrame, captures: DataFrame) -> DataFrame:
    """``probe_candidates`` with ``pos``, the path's place in the order of the search."""
    tried = origins.select("origin", F.posexplode(F.array(*map(F.lit, DOC_PATHS))).alias("pos", "path")).withColumn("url", F.concat("origin", "path"))
    found = joined(tried, captures.where("status = 200").select("url", "content_type", "body"), "url")
    html = F.contains(F.lower("content_type"), F.lit("html"))
    # told here and not by a filter, which would be pushed down to the scan of the names, often one task
    good = F.when(urls.is_forge(F.col("origin")), F.lit(None)).when(F.col("path").endswith("llms.txt"), F.when(~html, 0.95)).when(html & ((F.length(text.visible_text(F.col("body"))) >= MIN_TEXT) | urls.is_docs_host(F.col("url"))), 0.70)
    rated = found.select("origin", "url", "pos", good.alias("confidence")).where("confidence is not null")
    stop = F.min(F.when(F.col("confidence") >= 0.95, F.col("pos"))).over(Window.partitionBy("origin"))
    return rated.withColumn("stop", stop).where("stop is null or pos <= stop").select("origin", "url", "pos", "confidence")


def domain_candidates(wanted: DataFrame, captures: DataFrame) -> DataFrame:
    """(name, url, tld, score, why) of a name's own domains that are live and look like software: the best two."""
    tried = wanted.select("name", names.normalise(F.col("name")).alias("slug")).where(F.length("slug") >= 2)
    tried = tried.select("name", "slug", F.explode(F.array(*map(F.lit, TLDS))).alias("tld")).withColumn("origin", F.concat(F.lit("https://"), "slug", F.lit("."), "tld"))
    live = joined(tried, captures.where((F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("html"))).select(F.col("url").alias("origin"), "landed", "body"), "origin")
    rated = live.select("name", "tld", "landed", F.length(text.visible_text(F.col("body"))).alias("size"), looks_like_software(F.col("body"), F.col("slug")).alias("why"), domain_score(F.col("origin"), F.col("landed"), F.col("body"), F.col("slug")).alias("score"))
    rated = rated.where((F.col("size") >= MIN_TEXT) & (F.col("why") != ""))
    place = Window.partitionBy("name").orderBy(*[F.col(c).desc() for c in ("score", "size", "tld", "landed", "why")])
    return rated.withColumn("rank", F.row_number().over(place)).where("rank <= 2").select("name", F.col("landed").alias("url"), "tld", "score", "why", "rank")


def own_domain_candidates(wanted: DataFrame, captures: DataFrame) -> DataFrame:
    """(name, url, source, confidence, place) of a name's own domains: what is probed under one stands before it."""
    two = materialise(domain_candidates(wanted, captures).select("name", "url", F.concat(F.lit("domain:"), "tld").alias("source"), "rank"))
    roots = two.select("name", "rank", F.concat("source", F.lit("/probe")).alias("source"), urls.origin(F.col("url")).alias("origin"))
    under = joined(roots, probes(roots.select("origin").distinct(), captures), "origin")
    under = under.select("name", "url", "source", F.least(F.lit(0.97), F.col("confidence") + 0.02).alias("confidence"), "rank", "pos")
    every = under.unionByName(two.select("name", "url", "source", F.lit(0.75).alias("confidence"), "rank", F.lit(len(DOC_PATHS)).alias("pos")))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("rank", "pos"))).drop("rank", "pos")


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Per name all candidates with ``rank`` by confidence, each URL once (with or without a slash at its end)."""
    key = F.regexp_replace("url", "/+$", "")
    order = [F.col("confidence").desc(), F.col("source"), F.col("url")]
    once = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("name", key).orderBy(*order))).where("nth = 1").drop("nth")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order)))


def top_candidates(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """Per name the best of ``ranked_candidates``, for a list of fixed length; resolution looks at all of them."""
    return ranked_candidates(candidates).where(F.col("rank") <= most)


def best_verified(ranked: DataFrame) -> DataFrame:
    """Per name the first verified candidate in rank order; null where there is none."""
    return ranked.groupBy("name").agg(F.min_by(F.when(F.col("verified"), F.col("url")), F.when(F.col("verified"), F.col("rank"))).alias("best"), F.count("*").alias("candidates"))


def resolve(domain: DataFrame, registry: DataFrame, most: int | None = None) -> DataFrame:
    """Batch resolution: a verified candidate of the name's own domain ends it; else all candidates by confidence.

    Both: name, url, source, confidence, verified. An unverified candidate is never the best. ``most`` looks at so many
    candidates of a name alone.
    """
    done = domain.where("verified").select("name").distinct()
    first = joined(domain, done, "name", "left_semi").withColumn("via", F.lit("domain"))
    rest = joined(registry.unionByName(domain), done, "name", "left_anti").withColumn("via", F.when(F.col("source").startswith("domain:"), "domain").otherwise("registry"))
    every = first.unionByName(rest)
    ranked = ranked_candidates(every) if most is None else top_candidates(every, most)
    best = F.when(F.col("verified"), F.struct("url", "via"))
    out = ranked.groupBy("name").agg(F.min_by(best, F.when(F.col("verified"), F.col("rank"))).alias("b"), F.count("*").alias("candidates"))
    return out.select("name", F.col("b.url").alias("best"), F.coalesce("b.via", F.lit("unresolved")).alias("via"), "candidates")


def resolve_names(wanted: DataFrame, declared: DataFrame, captures: DataFrame, order: list[str] = REGISTRIES) -> DataFrame:
    """(name, best, via, ecosystem, candidates) of each of ``wanted`` (name, hint), from captured pages alone.

    A verified page of the name's own domain ends the search. Else ``declared`` (``registry_candidates``; of a hinted
    name only that registry), the own domains and the conventional paths under whatever is weak and not
    documentation are pooled, all are verified against what the registries declare, and the first verified one
    wins (tables without bodies that several steps read are written once); the ecosystem is the winning registry, else the hint, else the first registry that answered. A name that no
    registry knows stays unresolved. A candidate that was not captured is never verified.
    """
    pages = captures.where("status = 200").select("url", "body")
    own = materialise(own_domain_candidates(wanted, captures))
    blank = F.lit(None).cast("string")
    by_itself = own.withColumns({"ecosystem": blank, "repository": blank, "homepage": blank, "via_domain": F.lit(True)})
    judged = signals(joined(by_itself, pages, "url", "left"))
    first = materialise(judged.groupBy("name").agg(F.min_by(F.when(F.col("verified"), F.col("url")), F.when(F.col("verified"), F.col("place"))).alias("own_best"), F.count("*").alias("own_count")))
    done = first.where("own_best is not null").select("name")

    hint = F.coalesce("hint", F.lit(""))
    answers = materialise(joined(joined(declared, wanted, "name").where((hint == "") | (hint == F.col("ecosystem"))), done, "name", "left_anti"))
    hit = materialise(registry_order(answers.select("name", "hint", "ecosystem").distinct(), order).drop("answers"))
    found = answers.select("name", "url", "source", names.score(F.col("url"), F.col("field")).alias("confidence"))
    found = materialise(found.unionByName(joined(own.drop("place"), hit.select("name"), "name", "left_semi")))
    weak = found.where((F.col("confidence") < 0.9) & ~urls.looks_like_docs(F.col("url"))).select("name", urls.origin(F.col("url")).alias("origin")).distinct()
    extra = joined(weak, probes(weak.select("origin").distinct(), captures), "origin").select("name", "url", F.lit("probe").alias("source"), "confidence")
    ranked = joined(joined(ranked_candidates(found.unionByName(extra)), hit, "name"), registry_facts(answers), "name", "left")
    hinted = joined(ranked, wanted, "name").withColumn("ecosystem", F.coalesce(F.nullif(hint, F.lit("")), F.col("first")))
    rated = signals(joined(hinted.withColumn("via_domain", F.col("source").startswith("domain:")), pages, "url", "left"))
    best = F.when(F.col("verified"), F.struct("url", "source"))
    pooled = rated.groupBy("name").agg(F.min_by(best, F.when(F.col("verified"), F.col("rank"))).alias("b"), F.count("*").alias("pool_count"))

    out = joined(joined(joined(wanted, first, "name", "left"), pooled, "name", "left"), hit, "name", "left")
    registry = F.split_part("b.source", F.lit(":"), F.lit(1))
    via = F.when(F.col("own_best").isNotNull() | F.col("b.source").startswith("domain:"), "domain").when(F.col("b.url").isNotNull(), "registry").otherwise("unresolved")
    won = F.when(registry.isin(*order), registry)
    return out.select("name", F.coalesce("own_best", "b.url").alias("best"), via.alias("via"), F.coalesce(won, F.nullif(hint, F.lit("")), F.col("first"), F.lit("")).alias("ecosystem"), F.coalesce("pool_count", "own_count", F.lit(0)).alias("candidates"))


def alias(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(asked, technology): exact name, else the only one that normalises alike, else the only one that it begins.

    Prefixes of 3 letters or more are looked up by equality on every prefix of the stored names.
    """
    have = stored.select("technology", names.normalise(F.col("technology")).alias("slug")).distinct()
    want = asked.select("asked", names.normalise(F.col("asked")).alias("slug")).distinct()
    exact = have.select(F.col("technology").alias("asked"), F.col("technology").alias("t1"))
    same = have.groupBy("slug").agg(F.count("*").alias("n2"), F.min("technology").alias("t2"))
    cuts = have.where("length(slug) >= 3").select("technology", F.explode(F.transform(F.sequence(F.lit(3), F.length("slug")), lambda n: F.substring(F.col("slug"), F.lit(1), n))).alias("slug"))
    prefix = cuts.groupBy("slug").agg(F.count("*").alias("n3"), F.min("technology").alias("t3"))
    rows = joined(joined(joined(want, exact, "asked", "left"), same, "slug", "left"), prefix, "slug", "left")
    return rows.select("asked", F.coalesce("t1", F.when(F.col("n2") == 1, F.col("t2")), F.when(F.col("n2").isNull() & (F.col("n3") == 1), F.col("t3"))).alias("technology"))


def accuracy(resolved: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts of correct, wrong, unresolved and wrong-but-verified answers against expected hosts (name, host)."""
    rows = joined(resolved, expected, "name")
    right = urls.bare_host(F.col("best")) == F.col("host")
    return rows.agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.count_if(F.col("best").isNull()).alias("unresolved"), F.count_if(~right & F.col("verified")).alias("wrong_verified"))
