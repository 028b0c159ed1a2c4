"""Detection and extraction: captured responses to Markdown pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.session import ship_package

# Page furniture that is dropped, and where the main content usually is, in this order.
CHROME_TAGS = ["nav", "header", "footer", "aside", "script", "style", "noscript", "form", "iframe"]
CHROME_ROLES = ["navigation", "banner", "contentinfo"]
CHROME_CLASSES = ["sidebar", "navbar", "toc", "breadcrumb", "ad", "cookie"]
CONTENT = ["main", "article", "[role=main]", ".markdown-body", ".doc-content", ".content", ".prose", "#content", "#main"]
DUMP_NAMES = ["llms-full.txt", "llms-medium.txt"]
HTTP_METHODS = ["get", "put", "post", "delete", "options", "head", "patch"]
SPLIT_FROM, LEAST_PARTS, MOST_PARTS = 60_000, 3, 4000
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}


def classify(captures: DataFrame, forced: Column | None = None) -> DataFrame:
    """``kind`` of each capture: github, llms_txt, sitemap, openapi, raw_text or html.

    A site whose origin has a captured link index or dump is read through that (``resolved_url``).
    """
    url, p = F.col("url"), F.lower(urls.path(F.col("url")))
    published = captures.where("status = 200").select("url", urls.origin(url).alias("origin")).where(F.lower(F.col("url")).rlike(r"^[a-z]+://[^/]+/llms(-full)?\.txt$"))
    published = published.groupBy("origin").agg(F.min(F.struct((~F.col("url").contains("-full")).alias("later"), "url"))["url"].alias("index_url"))
    rows = captures.withColumn("origin", urls.origin(url)).join(published, "origin", "left")
    data = p.rlike(r"\.(json|ya?ml)$")
    kind = (
        F.when(urls.bare_host(url).isin("github.com") & ~p.rlike(r"\.(md|txt)$"), "github")
        .when(p.rlike(r"llms(-full|-medium)?\.txt$"), "llms_txt")
        .when(p.rlike(r"sitemap[^/]*\.xml$"), "sitemap")
        .when(data & text.looks_like_openapi(F.col("body")), "openapi")
        .when(data | p.rlike(r"\.(md|markdown|txt|rst)$"), "raw_text")
        .when(F.col("index_url").isNotNull(), "llms_txt")
        .otherwise("html")
    )
    resolved = F.when((kind == "llms_txt") & ~p.endswith(".txt"), F.col("index_url")).otherwise(url)
    return rows.select("id", "url", (F.coalesce(forced, kind) if forced is not None else kind).alias("kind"), resolved.alias("resolved_url"))


def fuller_dump(indexes: DataFrame, captures: DataFrame, least: int = 1000) -> DataFrame:
    """For each index the fullest dump captured: full beside it, full at the origin, medium beside it, medium at the origin."""
    folder = F.regexp_extract("url", "^(.*/)[^/]*$", 1)
    places = [F.concat(place, F.lit(name)) for name in DUMP_NAMES for place in (folder, F.concat(urls.origin(F.col("url")), F.lit("/")))]
    wanted = indexes.select("url", F.posexplode(F.array(*places)).alias("tier", "dump"))
    good = captures.where((F.col("status") == 200) & ~F.lower(F.ltrim("body")).startswith("<") & (F.length("body") >= least)).select(F.col("url").alias("dump"), F.length("body").alias("size"))
    best = wanted.join(good, "dump").groupBy("url").agg(F.min_by(F.struct("dump", "size"), "tier").alias("d"))
    return indexes.select("url").join(best, "url", "left").select("url", F.coalesce("d.dump", "url").alias("dump"), F.col("d.size").alias("size"))


def links(captures: DataFrame) -> DataFrame:
    """(id, pos, target) of every link in document order, resolved and normalised."""
    found = F.regexp_extract_all("body", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)"), 1)
    rows = captures.select("id", "url", F.posexplode(found).alias("pos", "link"))
    return rows.select("id", "pos", urls.normalise(urls.resolve(F.col("link"), F.col("url"))).alias("target"))


def follow_stubs(captures: DataFrame, most: int = 4000) -> DataFrame:
    """(id, url, target, landed): one hop of small pages that redirect by a meta tag or a script.

    A target captured several times is judged by its first capture after the stub's, by id, else by the last before it.
    """
    tag = F.regexp_extract("body", r"(?is)<meta\b(?=[^>]*\brefresh\b)[^>]*>", 0)
    meta = F.regexp_extract(tag, r"(?i)\burl\s*=\s*([^\s\"'<>;]+)", 1)
    # an assignment to the location or to its href, or a call of replace or assign
    script = F.regexp_extract("body", r"(?i)\blocation\s*(?:\.\s*href\s*)?(?:=|\.\s*(?:replace|assign)\s*\()\s*[\"']([^\"']+)[\"']", 1)
    link = F.coalesce(F.nullif(meta, F.lit("")), F.nullif(script, F.lit("")))
    # exploding keeps the optimiser from repeating the patterns in every filter on the target
    found = captures.where(F.length("body") <= most).select("id", "url", F.explode(F.array(link)).alias("link")).where("link is not null")
    stubs = found.select("id", "url", F.explode(F.array(urls.resolve(F.col("link"), F.col("url")))).alias("target")).where("target is not null")
    stubs = stubs.where(F.regexp_replace("target", "/$", "") != F.regexp_replace("url", "/$", ""))
    # captures of each target in the order of ids, the stubs that lead there between them
    seen = captures.select("id", F.lit(None).cast("string").alias("url"), F.col("url").alias("target"), F.struct(F.coalesce(F.col("status") == 200, F.lit(False)).alias("landed")).alias("seen"))
    both = seen.unionByName(stubs.withColumn("seen", F.lit(None).cast("struct<landed:boolean>")))
    place = Window.partitionBy("target").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = (F.last("seen", ignorenulls=True).over(place.orderBy(by, F.col("url").isNull())) for by in (F.asc("id"), F.desc("id")))
    judged = both.withColumn("before", before).withColumn("after", after).where("seen is null")
    return judged.select("id", "url", "target", F.coalesce("after.landed", "before.landed", F.lit(False)).alias("landed"))


def split_dumps(dumps: DataFrame, least_size: int = SPLIT_FROM) -> DataFrame:
    """(source, part, title, anchor, markdown): large texts cut at the heading level that has most headings.

    Of levels 1 to 3 those count that have 3 to 4000 headings; ties go to the shallower one. What stands before
    the first heading is a part too; a text that would give fewer than two parts stays whole.
    """
    body = F.col("text")
    counted = dumps.withColumn("n", F.array(*[F.regexp_count(body, F.lit(rf"(?m)^{'#' * k}[ \t]+\S")) for k in (1, 2, 3)]))
    fine = F.transform("n", lambda n: F.when(n.between(LEAST_PARTS, MOST_PARTS), n).otherwise(0))
    level = F.when((F.length(body) < least_size) | (F.array_max(fine) == 0), 0).otherwise(F.array_position(fine, F.array_max(fine)))
    parts = F.array(body)
    for k in (1, 2, 3):
        parts = F.when(level == k, F.filter(F.split(body, rf"(?m)(?=^{'#' * k}[ \t]+\S)"), lambda p: F.trim(p) != "")).otherwise(parts)
    rows = counted.select("source", F.posexplode(F.when(F.size(parts) < 2, F.array(body)).otherwise(parts)).alias("part", "markdown"))
    title = F.left(F.trim(F.regexp_replace(F.regexp_replace(F.split_part("markdown", F.lit("\n"), F.lit(1)), r"<[^>]+>", ""), r"^[# ]+", "")), F.lit(90))
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit("Overview"))
    return rows.select("source", "part", title.alias("title"), urls.anchor(title).alias("anchor"), "markdown")


#: Inline marks of Markdown, by tag.
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*"}
BLOCKS = ("p", "div", "section", "article", "table", "blockquote", "main")


class _Page(HTMLParser):
    """Title and Markdown of a page: headings, nested lists, tables, links, code, emphasis and paragraphs.

    Tags that are never closed end with what they stand in.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.in_title, self.skip = "", False, []
        self.open: list[tuple[str, list[int], str]] = []
        self.out: list[str] = []
        self.areas: dict[int, list[str]] = {}
        self.pre, self.lists, self.cells, self.heads = 0, [], 0, 0

    def _emit(self, piece: str) -> None:
        self.out.append(piece)
        for _, areas, _ in self.open:
            for a in areas:
                self.areas[a].append(piece)

    def _break(self, lines: str) -> None:
        """A cell of a table is one line."""
        self._emit(" " if self.cells else lines)

    def _begin(self, tag: str, a: dict[str, str]) -> str:
        """Emits what a tag begins with; what it ends with."""
        if tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            self._break("\n\n")
        elif re.fullmatch("h[1-6]", tag):
            self._break("\n\n" + "#" * int(tag[1]) + " ")
            return "\n\n"
        elif tag in ("ul", "ol"):
            if not self.lists:
                self._break("\n\n")
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = "- " if not self.lists or self.lists[-1] is None else f"{self.lists[-1]}. "
            self._break("\n" + "  " * (len(self.lists) - 1) + mark)
        elif tag == "br":
            self._break("\n")
        elif tag == "tr":
            self._emit("\n|")
            self.heads = 0
        elif tag in ("td", "th"):
            self.cells += 1
            self.heads += tag == "th"
            self._emit(" ")
            return " |"
        elif tag == "pre":
            self.pre += 1
            self._emit("\n\n```\n")
            return "\n```\n\n"
        elif self.pre:
            return ""
        elif tag == "code":
            self._emit("`")
            return "`"
        elif tag in INLINE:
            self._emit(INLINE[tag])
            return INLINE[tag]
        elif tag == "a" and a.get("href"):
            self._emit("[")
            return f"]({a['href']})"
        return ""

    def _end(self) -> None:
        """Ends the innermost open tag."""
        tag, _, last = self.open[-1]
        if tag == "tr" and self.heads:
            last = "\n|" + " --- |" * self.heads
        elif tag in ("td", "th"):
            self.cells -= 1
        elif tag == "pre":
            self.pre -= 1
        elif tag in ("ul", "ol"):
            self.lists.pop()
            last = "" if self.lists or self.cells else "\n\n"
        elif tag == "title":
            self.in_title = False
        if last:
            self._emit(last)
        self.open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: (v or "") for k, v in attrs}
        marks = a.get("class", "").split()
        chrome = tag in CHROME_TAGS or a.get("role") in CHROME_ROLES or a.get("aria-hidden") == "true" or any(m in CHROME_CLASSES for m in marks)
        if self.skip or chrome:
            if tag not in VOID:
                self.skip.append(tag)
            return
        # an item, row or cell ends the one before it
        inner = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(tag)
        if inner:
            same = ("td", "th") if tag in ("td", "th") else (tag,)
            names = [t for t, _, _ in self.open]
            at = max((i for i, t in enumerate(names) if t in same), default=-1)
            if at > max((i for i, t in enumerate(names) if t in inner), default=-1):
                while len(self.open) > at:
                    self._end()
        last = self._begin(tag, a)
        if tag not in VOID:
            mine = [i for i, c in enumerate(CONTENT) if i not in self.areas and (tag == c or c == f"#{a.get('id')}" or c[0] == "." and c[1:] in marks or c == f"[role={a.get('role')}]")]
            for i in mine:
                self.areas[i] = []
            self.open.append((tag, mine, last))

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if any(t == tag for t, _, _ in self.open):
            ended = None
            while ended != tag:
                ended = self.open[-1][0]
                self._end()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            text = data if self.pre else re.sub(r"\s+", " ", data)
            if not self.pre and (not self.out or self.out[-1].endswith("\n")):
                text = text.lstrip(" ")
            if text:
                self._emit(text)


def _tidy(pieces: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(pieces))).strip()


def page_of(html: str) -> tuple[str, str]:
    """Title and Markdown of a page's main content."""
    page = _Page()
    page.feed(html)
    page.close()
    for i in range(len(CONTENT)):
        body = _tidy(page.areas.get(i, []))
        if len(body) > 200:
            return page.title.strip() or "Untitled", body
    return page.title.strip() or "Untitled", _tidy(page.out)


#: Pages that a worker holds as Python strings at once.
PAGES_A_SLICE = 200


def extract_pages(captures: DataFrame, *keep: str) -> DataFrame:
    """(id, url, title, markdown, error) of each capture; one that fails has an error and no page. Columns of ``keep`` go along."""
    ship_package(captures.sparkSession)
    kept = "".join(f", `{c}` {captures.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAGES_A_SLICE):
                batch = whole.slice(start, PAGES_A_SLICE)
                rows = []
                for body in batch.column("body"):
                    try:
                        rows.append((*page_of(body.as_py() or ""), None))
                    except Exception as e:  # one bad row never ends a job
                        rows.append((None, None, str(e)))
                found = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *found, *[batch.column(c) for c in keep]], names=["id", "url", "title", "markdown", "error", *keep])

    return captures.select(F.col("id").cast("long").alias("id"), "url", "body", *keep).mapInArrow(run, f"id long, url string, title string, markdown string, error string{kept}")


def bundle(docs: DataFrame, key: str) -> DataFrame:
    """One text for each key: a document alone as it is, several with a contents list first."""
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "markdown"))).alias("d"))
    listing = F.array_join(F.transform("d", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"])), "\n")
    bodies = F.array_join(F.transform("d", lambda x: F.concat(F.lit("# "), x["title"], F.lit("\n\n"), x["markdown"])), "\n\n---\n\n")
    return rows.select(key, F.when(F.size("d") == 1, F.col("d")[0]["markdown"]).otherwise(F.concat(listing, F.lit("\n\n"), bodies)).alias("text"))
