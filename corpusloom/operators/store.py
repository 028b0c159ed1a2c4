"""The page store: pages under technology, version and ordinal, and what is asked of it.

Tables: pages (technology, version, ordinal, title, url, content) and versions (technology, version, source,
strategy, complete, expected, harvested_at). A version's label, not its harvest, says which is the newest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, urls, versions
from corpusloom.session import number_rows, ship_package

KEYS = ["technology", "version"]
PAGE_SCHEMA = "technology string, version string, ordinal long, title string, url string, content string"


def merged_complete(complete: Column) -> Column:
    """Any false: false; else any unknown: unknown; else true (also of nothing)."""
    return F.when(F.count_if(~complete) > 0, False).when(F.count(F.lit(1)) > F.count(complete), F.lit(None).cast("boolean")).otherwise(True)


def recency() -> Column:
    """What orders versions newest last: the label's key, the harvest, the label."""
    return F.struct(versions.sort_key(F.col("version")).alias("key"), F.col("harvested_at"), F.col("version"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """Pages and characters of each version; a saved store knows its pages' lengths, and no content is read."""
    length = F.col("characters") if "characters" in pages.columns else F.length("content")
    return pages.groupBy(*KEYS).agg(F.count("*").alias("pages"), F.sum(length).cast("long").alias("characters"))


def version_list(doc_versions: DataFrame, pages: DataFrame) -> DataFrame:
    """Versions with pages and characters; a version without pages has 0 of both."""
    out = doc_versions.join(page_sizes(pages), KEYS, "left")
    return out.select(*doc_versions.columns, F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("characters", F.lit(0)).alias("characters"))


def technology_list(doc_versions: DataFrame, pages: DataFrame, contains: str = "") -> DataFrame:
    """One row per technology whose name contains the text: counts, newest label, last harvest, completeness."""
    rows = version_list(doc_versions.where(F.contains(F.lower("technology"), F.lit(contains.lower()))), pages)
    return rows.groupBy("technology").agg(
        F.count("*").alias("versions"),
        F.sum("pages").alias("pages"),
        F.sum("characters").alias("characters"),
        F.max_by("version", recency()).alias("latest"),
        F.date_format(F.max("harvested_at"), "yyyy-MM-dd HH:mm").alias("last_harvest"),
        merged_complete(F.col("complete")).alias("complete"),
    )


def entry(doc_versions: DataFrame) -> DataFrame:
    """Each technology's newest version row."""
    best = doc_versions.groupBy("technology").agg(F.max_by(F.struct(*doc_versions.columns), recency()).alias("row"))
    return best.select("row.*")


def numbered(pages: DataFrame) -> DataFrame:
    """Keys, ``came`` (the order of the input) and ordinals 1 to n of each version, by ranges of narrow rows."""
    rows = number_rows(pages.select(*KEYS, F.col("ordinal").alias("came")), KEYS, [F.col("came")])
    return rows.select(*KEYS, "came", (F.col("number") + 1).alias("ordinal"))


def replace_versions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store after saving ``new``: its (technology, version) pairs replaced, all others as they were."""
    return stored.join(new.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(new)


def with_ordinals(pages: DataFrame) -> DataFrame:
    """``pages`` with ordinals 1 to n in each version, in the order of those given and of URLs; equal ones stay equal.

    Narrow rows are numbered by ranges, so a large version is no single task, and joined back by all that they hold.
    """
    numbers = number_rows(pages.select(*KEYS, "ordinal", "url").distinct(), KEYS, [F.col("ordinal")], "url").alias("r")
    same = F.lit(True)
    for c in (*KEYS, "ordinal", "url"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    kept = [(F.col("r.number") + 1).alias("ordinal") if c == "ordinal" else F.col(f"r.{c}") if c in KEYS else F.col(f"l.{c}") for c in pages.columns]
    return pages.alias("l").join(numbers, same).select(*kept)


#: Pages in one file of a saved version.
PAGES_A_FILE = 20_000
#: Fixed value: the folder name that Spark reads as a null partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def save(new: DataFrame, path: str, pages_a_file: int = PAGES_A_FILE) -> None:
    """Replace the partitions of ``new`` in the stored table, pages numbered from 1; versions that it does not hold stay.

    A version has a file for every ``pages_a_file`` of its ordinals, each with a writer of its own. Readers that ask for
    a technology or version read its folders alone, and those that ask for ordinals the files whose range holds them;
    ``characters`` keeps each content's length. Versions are replaced one after another when the job ends: a reader at
    that moment may find some old and some new.
    """
    rows = with_ordinals(new).withColumn("characters", F.length("content").cast("long"))
    for key in KEYS:  # never null, so that the writer keeps the order of ordinals instead of sorting by the keys alone
        rows = rows.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(NO_VALUE)))
    dealt = rows.repartition(*KEYS, F.floor((F.col("ordinal") - 1) / pages_a_file))
    writer = dealt.sortWithinPartitions(*KEYS, "ordinal").write.mode("overwrite").option("maxRecordsPerFile", pages_a_file)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def delete(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages left after deleting ``targets`` (technology, version; a null version means all of them)."""
    same = (F.col("p.technology") == F.col("t.technology")) & (F.col("t.version").isNull() | (F.col("p.version") == F.col("t.version")))
    return pages.alias("p").join(targets.alias("t"), same, "left_anti")


def delete_preview(doc_versions: DataFrame, pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Per technology named: versions, pages and characters that would go, and versions that would remain."""
    rows = version_list(doc_versions, pages).alias("v").join(targets.alias("t"), "technology")
    goes = F.col("t.version").isNull() | (F.col("v.version") == F.col("t.version"))
    return rows.groupBy("technology").agg(
        F.count_if(goes).alias("versions"),
        F.coalesce(F.sum(F.when(goes, F.col("pages"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(goes, F.col("characters"))), F.lit(0)).alias("characters"),
        F.count_if(~goes).alias("remaining"),
    )


def contents(pages: DataFrame) -> DataFrame:
    """A numbered contents list of each version, which is one row of titles; ``file_pieces`` has it as rows."""
    titles = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("title", F.lit("")).alias("title"))))
    line = lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t["title"])
    return pages.groupBy(*KEYS).agg(F.array_join(F.transform(titles, line), "\n").alias("contents"))


def first_titles(pages: DataFrame, most: int = 2000) -> DataFrame:
    """(technology, version, titles): the first ``most`` titles of each version; the others never reach its group."""
    rows = number_rows(pages.select(*KEYS, "ordinal", "title"), KEYS, [F.col("ordinal")], "title").where(F.col("number") < most)
    titles = F.array_sort(F.collect_list(F.struct("number", "title")))
    return rows.groupBy(*KEYS).agg(F.array_join(F.transform(titles, lambda t: t["title"]), "\n").alias("titles"))


def _block() -> Column:
    return F.concat(F.lit("\n---\n\n## "), F.col("title"), F.lit("\n\nSource: <"), F.col("url"), F.lit(">\n\n"), F.col("content"), F.lit("\n"))


def _head() -> Column:
    return F.concat(F.lit("# "), F.col("technology"), F.lit(" "), F.col("version"), F.lit("\n"))


def combined_blocks(pages: DataFrame) -> DataFrame:
    """The combined texts as rows (technology, version, ordinal, block), one for each page; no version is collected."""
    return pages.select(*KEYS, "ordinal", _block().alias("block"))


def save_blocks(blocks: DataFrame, path: str, files: int | None = None) -> None:
    """Part files of ordered blocks (``files`` or as adaptive execution sizes them); a large version has several, in the order of their names."""
    by = [*KEYS, "ordinal", "__salt"]
    salted = blocks.withColumn("__salt", F.monotonically_increasing_id())
    salted = salted.repartitionByRange(files, *by) if files else salted.repartitionByRange(*by)
    salted.sortWithinPartitions(*KEYS, "ordinal", "block").drop("__salt").write.mode("overwrite").parquet(path)


def combined(pages: DataFrame) -> DataFrame:
    """One Markdown text of each version: title, page blocks in order.

    A version is one row here, so it must be far below 2 GB (Spark's row and array limits) and fit a task several
    times; ``combined_blocks``, ``text_digests`` and ``split_blocks`` have no such bound.
    """
    rows = combined_blocks(pages).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ordinal", "block"))).alias("blocks"))
    return rows.select(*KEYS, F.concat(_head(), F.array_join(F.transform("blocks", lambda b: b["block"]), "")).alias("text"))


def text_digests(rows: DataFrame, piece: str, between: str = "", head: Column | None = None) -> DataFrame:
    """(technology, version, text_sha256): SHA-256 of each version's pieces joined in order, without joining them.

    A version's rows are sorted in one task, which may spill, and run through the digest one by one. Null pieces
    are left out.
    """
    ship_package(rows.sparkSession)
    # by a hash of the keys: a repartition by the very keys of a join before it is dropped, and adaptive execution may then undo the join's
    parts = rows.select(*KEYS, "ordinal", F.col(piece).alias("piece")).repartition(F.xxhash64(*KEYS)).sortWithinPartitions(*KEYS, "ordinal", "piece")
    parts = parts.select(*KEYS, "piece", (head if head is not None else F.lit("")).alias("head"))
    joint = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, first = None, None, True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"technology": [last[0]], "version": [last[1]], "text_sha256": [digest.hexdigest()]}, schema=schema)

        schema = pa.schema([("technology", pa.string()), ("version", pa.string()), ("text_sha256", pa.string())])
        for batch in batches:
            for technology, version, text_, start in zip(*[batch.column(i) for i in range(4)], strict=True):
                key = (technology.as_py(), version.as_py())
                if key != last:
                    if last is not None:
                        yield done()
                    last, digest, first = key, hashlib.sha256(start.as_py().encode()), True
                if text_.is_valid:
                    digest.update((b"" if first else joint) + text_.as_py().encode())
                    first = False
        if last is not None:
            yield done()

    return parts.mapInArrow(run, "technology string, version string, text_sha256 string")


def combined_digests(pages: DataFrame) -> DataFrame:
    """(technology, version, text_sha256) of the combined texts."""
    return text_digests(combined_blocks(pages), "block", head=_head())


def file_pieces(pages: DataFrame, doc_versions: DataFrame) -> DataFrame:
    """(technology, version, ordinal, piece): the rows that, joined in order, make each version's documentation file.

    Fixed values: the layout, which is a title by the source's host, a comment with pages, source, strategy and time,
    numbered contents with links, and each page after a rule, without its own stamp. ``ordinal`` is (part, number).
    Contents go through no window and no version is collected: the list is numbered by ranges over titles and URLs.
    Two blank lines stay at the end where a version's last page has no content.
    """
    number_of = lambda part, number: F.struct(F.lit(part).alias("part"), F.col(number).cast("long").alias("number")).alias("ordinal")
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    sizes = pages.groupBy(*KEYS).agg(F.count("*").alias("pages"))
    about = doc_versions.join(sizes, KEYS).withColumn("first", F.lit(0))
    host = F.coalesce(F.nullif(urls.host(filled("source")), F.lit("")), filled("source"))
    comment = F.concat(F.lit("<!-- harvested: "), F.col("pages").cast("string"), F.lit(" pages | from: "), filled("source"), F.lit(" | via: "), filled("strategy"), F.lit(" | "), F.coalesce(F.date_format("harvested_at", "yyyy-MM-dd HH:mm"), F.lit("")), F.lit(" -->"))
    heads = about.select(*KEYS, number_of(0, "first"), F.concat(F.lit("# "), host, F.lit(" documentation\n\n"), comment, F.lit("\n\n## Contents\n\n")).alias("piece"))
    titles = number_rows(pages.select(*KEYS, "ordinal", filled("title").alias("title"), filled("url").alias("url")), KEYS, [F.col("ordinal")], "url")
    line = F.concat((F.col("number") + 1).cast("string"), F.lit(". ["), "title", F.lit("]("), "url", F.lit(")\n"))
    listed = titles.select(*KEYS, number_of(1, "number"), line.alias("piece"))
    body = F.regexp_replace(text.strip_stamp(filled("content")), r"^\s+|\s+$", "")
    block = F.concat(F.lit("\n\n---\n\n## "), filled("title"), F.lit("\n\nSource: <"), filled("url"), F.lit(">\n\n"), body, F.lit("\n"))
    return heads.unionByName(listed).unionByName(pages.select(*KEYS, number_of(2, "ordinal"), block.alias("piece")))


def file_digests(pages: DataFrame, doc_versions: DataFrame) -> DataFrame:
    """(technology, version, text_sha256) of the documentation files."""
    return text_digests(file_pieces(pages, doc_versions), "piece")


def pages_by_ordinal(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Each page asked for (technology, version, ordinal), with ``found`` and ``reason``: a page that is not there is a row too."""
    by = [*KEYS, "ordinal"]
    rows = asked.join(pages.select(*by, "title", "url", "content", F.lit(True).alias("there")), by, "left")
    found = F.coalesce("there", F.lit(False))
    reason = F.when(~found, F.concat(F.col("technology"), F.lit(" has no page "), F.col("ordinal").cast("string")))
    return rows.select(*by, found.alias("found"), reason.alias("reason"), "title", "url", "content")


def split_blocks(blocks: DataFrame) -> DataFrame:
    """The pages of combined blocks, a row each, with ordinals 1 to n of each version."""
    form = r"(?s)\A\n---\n\n## (.*?)\n\nSource: <(.*?)>\n\n(.*)\n\z"
    rows = number_rows(blocks.where("block is not null"), KEYS, [F.col("ordinal")], "block")
    found = [F.regexp_extract("block", form, i).alias(name) for i, name in enumerate(("title", "url", "content"), 1)]
    return rows.select(*KEYS, (F.col("number") + 1).alias("ordinal"), *found)


def split_combined(texts: DataFrame) -> DataFrame:
    """The pages of combined texts; a page begins at a heading that a source line follows."""
    parts = F.split("text", r"\n(?=## [^\n]*\n+Source: <)")
    rows = texts.select(*KEYS, F.posexplode(parts).alias("pos", "part")).where("pos > 0")
    body = F.regexp_extract("part", r"(?s)^## [^\n]*\n+Source: <[^>]*>\n\n(.*)$", 1)
    return rows.select(
        *KEYS,
        F.col("pos").cast("long").alias("ordinal"),
        F.regexp_extract("part", r"^## ([^\n]*)", 1).alias("title"),
        F.regexp_extract("part", r"^## [^\n]*\n+Source: <([^>]*)>", 1).alias("url"),
        F.regexp_replace(body, r"\n(\n{1,2}---\n)?$", "").alias("content"),
    )


def read_section(pages: DataFrame, phrase: str) -> DataFrame:
    """Per version the pages whose title contains the phrase; only where there is none, those whose content does."""
    rows = pages.select(*KEYS, "ordinal", "title", "url", F.contains(F.lower("title"), F.lit(phrase.lower())).alias("by_title"), F.contains(F.lower("content"), F.lit(phrase.lower())).alias("by_content"))
    titled = rows.where("by_title or by_content").withColumn("any_title", F.max("by_title").over(Window.partitionBy(*KEYS)))
    return titled.where("by_title or not any_title").select(*KEYS, "ordinal", "title", "url", F.when(F.col("any_title"), "title").otherwise("content").alias("matched"))


def searched() -> Column:
    """What a substring search looks at, in lower case."""
    return F.lower(F.concat_ws("\n", "title", "url", "content"))


def substring_search(pages: DataFrame, phrase: str, limit: int) -> DataFrame:
    """The first hits in store order, with a snippet around the phrase."""
    hit = F.contains(searched(), F.lit(phrase.lower()))
    top = pages.where(hit).orderBy(*KEYS, "ordinal").limit(max(1, min(100, limit)))
    return top.select(*KEYS, "ordinal", "title", "url", text.snippet(F.col("content"), phrase).alias("snippet"))


def coverage(rows: DataFrame) -> DataFrame:
    """Flag and note of each version: whole, partial or unknown; of an expected number only where it is larger."""
    flag = F.when(F.col("complete"), "complete").when(~F.col("complete"), "partial").otherwise("unknown")
    note = F.when(F.col("expected") > F.col("pages"), F.format_string("%d of %d pages", "pages", "expected")).otherwise(F.format_string("%d pages", "pages"))
    return rows.select(*KEYS, flag.alias("flag"), note.alias("note"))
