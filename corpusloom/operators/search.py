"""Ranked search over an inverted index of the page store.

Score of a page: for each query term its occurrences in the title (at most 3) weigh 1.0 and in the content (at
most 10) 0.4 each; the sum over terms is divided by 1 + ln(1 + words of the content). All positive parts of a query must
occur; a term that is written twice counts once. Words are runs of letters and digits of any script, in lower case; terms are
words without stop words, their plain English endings cut. The index holds what ranking needs: the length of a page, and
each term's positions, so that phrases are found by intersection and no contents are read. Stop words have postings of
their own (``=the``), for phrases alone.

A stored index is made of segments, one for each save. A log names the segment that holds each version's postings, so that
a save, a replacement or a deletion becomes visible at once, when its log entries are written; a merge rewrites what is live.
Postings lie in blocks (pages of a version that share term and field; ``rows_of`` has them one by one). A band holds pages
of like length, and ``levels`` knows the largest weight of each term in each band, so that the ranked search takes bands by
the best score that they may hold, and stops where no page left can be among the best.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import substring
from corpusloom.operators.parts import PARTS, of_keys, part_of, parts_holding
from corpusloom.operators.store import KEYS
from corpusloom.session import Scratch, ship_package

PAGE = [*KEYS, "ordinal"]
STOP = "a an and are as at be by for from in is it of on or that the this to was with".split()
#: What separates words.
GAP = r"[^\p{L}\p{N}]+"
TITLE_WEIGHT, BODY_WEIGHT, TITLE_MOST, BODY_MOST = 1.0, 0.4, 3, 10


def stem(word: Column) -> Column:
    """A word without a plain English ending: of -ing, -ed, -es, -ly and -s the first that leaves 3 letters."""
    return F.regexp_replace(word, r"^(.{3,}?)(ing|ed|es|ly|s)$", "$1")


def stem_word(word: str) -> str:
    return re.sub(r"^(.{3,}?)(ing|ed|es|ly|s)$", r"\1", word)


def spaced(text: Column) -> Column:
    """The words of a text in lower case, with spaces between."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " ")


def words_of(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query)


def postings(pages: DataFrame) -> DataFrame:
    """``term, technology, version, ordinal, field (A title, B content), n, first, words, positions``: the inverted index.

    ``words`` is the length of the page's content, ``positions`` the term's places in the field, ascending.
    A page is one row: keys do not repeat.
    """
    ship_package(pages.sparkSession)
    # a page's words are numbered and put together by term within its row, so nothing is shuffled
    split = pages.select(*PAGE, spaced(F.col("title")).alias("of_title"), spaced(F.col("content")).alias("of_content"))
    keys = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in PAGE)
    found = split.mapInArrow(_cut, f"term string, {keys}, field string, words long, positions array<int>")
    return found.select("term", *PAGE, "field", F.size("positions").cast("long").alias("n"), F.get("positions", F.lit(0)).alias("first"), "words", "positions")


#: Pages, and bytes of their words, whose postings leave a worker together.
PAGES_A_SLICE, BYTES_A_SLICE = 2000, 8_000_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.add(*[pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("of_title", "of_content")])
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, ends[start] - sizes[start] + BYTES_A_SLICE, "right"))
            stop = min(batch.num_rows, start + PAGES_A_SLICE, max(start + 1, full))
            yield batch.slice(start, stop - start)
            start = stop


def _terms_of(words: pa.Array) -> pa.Array:
    """``stem`` of distinct words; stop words are marked."""
    stems = pc.replace_substring_regex(words, r"^(.{3,}?)(ing|ed|es|ly|s)$", r"\1")
    return pc.if_else(pc.is_in(words, pa.array(STOP)), pc.binary_join_element_wise("=", words, ""), stems)


def _sort_words(batch: pa.RecordBatch, groups: np.ndarray) -> dict | None:
    """The words of a slice's pages as postings, sorted by each page's group, field, term and page; None where there are no words.

    ``begins`` are the places where a (group, field, term) begins among the postings.
    """
    n, split, counts = batch.num_rows, [], []
    for column in ("of_content", "of_title"):
        texts = pc.utf8_trim(batch.column(column), " ")
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        split.append(words.filter(pc.not_equal(words, "")))
        counts.append(np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
    coded = pa.concat_arrays(split).dictionary_encode()
    if not len(coded):
        return None
    terms = _terms_of(coded.dictionary).dictionary_encode()
    term = terms.indices.to_numpy().astype(np.int64)[coded.indices.to_numpy()]
    page = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
    place = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in counts]).astype(np.int32)
    field = np.repeat(np.arange(2), [c.sum() for c in counts])
    most = len(terms.dictionary)
    key = ((groups[page] * 2 + field) * most + term) * n + page
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    group, pages = np.divmod(key[starts], n)
    return {
        "term": terms.dictionary.take(pa.array(group % most)),
        "field": pa.array(["B", "A"]).take(pa.array(group // most % 2)),
        "page": pages,
        "words": counts[0],
        "n": np.diff(starts, append=len(key)).astype(np.int32),
        "positions": pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place[order])),
        "begins": np.flatnonzero(np.diff(group, prepend=-1)),
    }


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of pages with their positions, from their spaced words."""
    for batch in _slices(batches):
        found = _sort_words(batch, np.arange(batch.num_rows))
        if found:
            rows = pa.array(found["page"])
            columns = [found["term"], *[batch.column(c).take(rows) for c in PAGE], found["field"], pa.array(found["words"][found["page"]]), found["positions"]]
            yield pa.RecordBatch.from_arrays(columns, names=["term", *PAGE, "field", "words", "positions"])


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same as blocks: a row for all pages of a slice that share version, field and term."""
    for batch in _slices(batches):
        seen: dict[tuple, int] = {}
        versions = np.array([seen.setdefault(v, len(seen)) for v in zip(*[batch.column(c).to_pylist() for c in KEYS], strict=True)])
        found = _sort_words(batch, versions)
        if found:
            begins, pages, words = found["begins"], found["page"], found["words"]
            ends = pa.array(np.append(begins, len(pages)), pa.int32())
            first, at = pa.array(pages[begins]), pa.array(begins)
            n, places = found["n"], found["positions"].values
            before = np.cumsum(n) - n
            starts = before - np.repeat(before[begins], np.diff(begins, append=len(pages)))
            of_pages = (batch.column("ordinal").take(pa.array(pages)), pa.array(words[pages], pa.int32()), pa.array(n), pa.array(starts, pa.int32()))
            lists = [*[pa.ListArray.from_arrays(ends, v) for v in of_pages], pa.ListArray.from_arrays(pa.array(np.append(before[begins], len(places)), pa.int32()), places)]
            columns = [found["term"].take(at), *[batch.column(c).take(first) for c in KEYS], found["field"].take(at), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=BLOCK)


#: Columns of a block of postings. Of the last five, four have an entry for each page; its ``ns`` positions begin at its place in ``starts``.
BLOCK = ["term", *KEYS, "field", "ordinals", "words", "ns", "starts", "positions"]
#: Ordinals of a version that are cut together, so that blocks hold many pages and no version is one task.
ORDINALS_A_TASK = 20_000


def blocks(pages: DataFrame) -> DataFrame:
    """The rows of ``postings`` as a stored index has them: pages that share version, field and term lie in few rows.

    Pages of a version are brought together first, since their texts are a fraction of their postings.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(*KEYS, F.col("ordinal").cast("long").alias("ordinal"), "title", "content")
    near = rows.repartition(*KEYS, F.floor(F.col("ordinal") / ORDINALS_A_TASK)).sortWithinPartitions(*PAGE)
    split = near.select(*PAGE, spaced(F.col("title")).alias("of_title"), spaced(F.col("content")).alias("of_content"))
    return split.mapInArrow(_cut_blocks, COLUMNS["postings"])


def rows_of(found: DataFrame) -> DataFrame:
    """The postings of blocks, a row each."""
    kept = [c for c in found.columns if c not in BLOCK[4:]]
    places = F.transform(F.arrays_zip("starts", "ns"), lambda x: F.slice("positions", x["starts"] + 1, x["ns"])).alias("places")
    each = found.select(*kept, "ordinals", "words", "ns", places).select(*kept, F.explode(F.arrays_zip("ordinals", "words", "ns", "places")).alias("page"))
    page = F.col("page")
    named = [page["ordinals"].alias("ordinal"), page["ns"].cast("long").alias("n"), F.get(page["places"], F.lit(0)).alias("first"), page["words"].cast("long").alias("words"), page["places"].alias("positions")]
    return each.select(*kept, *named, band_of(page["words"]).alias("band"))


#: Pages for which each part has one more writer, and so one more file.
PAGES_A_WRITER = 200_000


def band_of(words: Column) -> Column:
    """Pages whose lengths differ by a fourth or so share a band: all postings of a page lie in one."""
    return F.floor(4 * F.ln(1 + words)).cast("int")


def weight() -> Column:
    """What a posting adds to its page's score, before the division by length."""
    return F.when(F.col("field") == "A", TITLE_WEIGHT * F.least("n", F.lit(TITLE_MOST))).otherwise(BODY_WEIGHT * F.least("n", F.lit(BODY_MOST)))


#: The tables of a segment, and what deals each into parts.
TABLES = {"postings": ["term"], "titles": PAGE, "grams": ["gram"], "levels": ["term"]}
#: What an index may be for: ranked search and substring search read different tables.
RANKED, GRAMS = "ranked", "grams"
#: Their columns, so that no reader has to look into files for them.
COLUMNS = {
    "postings": "term string, technology string, version string, field string, ordinals array<long>, words array<int>, ns array<int>, starts array<int>, positions array<int>",
    "titles": "technology string, version string, ordinal long, title string",
    "grams": "gram string, technology string, version string, block long",
    "levels": "term string, field string, band int, rows long, most double, shortest long",
}


def _write(rows: DataFrame, table: str, within: list[str], spread: Column | None, path: str, segment: str) -> None:
    """Without ``spread`` the tasks of ``rows`` hold whole files' rows of few parts already, and nothing is shuffled."""
    key = TABLES[table]
    dealt = rows.withColumn("part", part_of(*[F.col(c) for c in key]))
    dealt = dealt if spread is None else dealt.repartition("part", spread)
    dealt.sortWithinPartitions("part", *key, *within).write.partitionBy("part").parquet(f"{path}/{table}/segment={segment}")


def _write_segment(found: DataFrame | None, titles: DataFrame | None, grams: DataFrame | None, pages: int | None, path: str, segment: str) -> None:
    """A part has as many writers as the number of ``pages`` asks for; a frequent term's postings are spread over all of them.

    ``found`` are blocks of postings. The levels are read off these as written. What is None is not for this index;
    without ``pages`` rows lie in the tasks that write them.
    """
    writers = F.lit(1 + (pages or 0) // PAGES_A_WRITER)
    spread = lambda *key: None if pages is None else F.pmod(F.xxhash64(*key), writers)
    if grams is not None:
        _write(grams, "grams", [*KEYS, "block"], spread(*KEYS, "block"), path, segment)
    if found is None:
        return
    _write(found, "postings", [], spread(*KEYS, F.get("ordinals", F.lit(0))), path, segment)
    _write(titles, "titles", [], spread(*PAGE), path, segment)
    rows = found.sparkSession.read.schema(f"{COLUMNS['postings']}, part int").parquet(f"{path}/postings/segment={segment}")
    # of each page its length and its term's occurrences alone
    each = rows.select("part", "term", "field", F.explode(F.arrays_zip("words", "ns")).alias("page")).select("part", "term", "field", F.col("page.words").cast("long").alias("words"), F.col("page.ns").alias("n"))
    # dealt by part once: nearly every page has a level of its own for most of its terms, so counting first would save no rows
    levels = each.repartition("part").groupBy("part", "term", "field", band_of(F.col("words")).alias("band")).agg(F.count("*").alias("rows"), F.max(weight()).alias("most"), F.min("words").alias("shortest"))
    _write(levels.select("term", "field", "band", "rows", "most", "shortest"), "levels", ["band"], None, path, segment)


LOG = "technology string, version string, segment string, save long"


def _log(spark: SparkSession, path: str) -> DataFrame:
    """All entries so far; a version's last one holds, and one without a segment is a deletion."""
    return spark.read.schema(LOG).parquet(f"{path}/log")


def _commit(entries: DataFrame, path: str) -> None:
    """Make a save visible; ``entries``: technology, version, segment."""
    spark = entries.sparkSession
    spark.createDataFrame([], LOG).write.mode("append").parquet(f"{path}/log")  # the first commit makes the folder
    last = _log(spark, path).agg(F.max("save")).first()[0] or 0
    entries.select(*KEYS, "segment", F.lit(last + 1).cast("long").alias("save")).coalesce(1).write.mode("append").parquet(f"{path}/log")


def live(spark: SparkSession, path: str) -> DataFrame:
    """(technology, version, segment) of the versions that the index holds now."""
    return _log(spark, path).groupBy(*KEYS).agg(F.max_by("segment", "save").alias("segment")).where("segment is not null")


def _uses(spark: SparkSession, path: str) -> tuple[str, ...]:
    """What the index at ``path`` is for, by its tables; nothing where there is none yet."""
    at = {use: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}") for use, table in ((RANKED, "postings"), (GRAMS, "grams"))}
    return tuple(use for use, folder in at.items() if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))


def add_to_index(pages: DataFrame, path: str, uses: tuple[str, ...] = (RANKED, GRAMS)) -> None:
    """The versions of ``pages`` as they are now: what the index held of them before is no longer live.

    All saves of an index have the same ``uses``, so that no search misses a save.
    """
    held = _uses(pages.sparkSession, path)
    if held and set(held) != set(uses):
        raise ValueError(f"the index at {path} is for {' and '.join(held)}")
    segment = f"s{uuid.uuid4().hex}"
    ranked = (blocks(pages), pages.select(*PAGE, "title")) if RANKED in uses else (None, None)
    with Scratch(pages.sparkSession) as scratch:
        versions = scratch.keep(pages.groupBy(*KEYS).agg(F.count("*").alias("pages")))  # one read of the pages for both
        _write_segment(*ranked, substring.grams(pages) if GRAMS in uses else None, versions.agg(F.sum("pages")).first()[0] or 0, path, segment)
        _commit(versions.select(*KEYS).withColumn("segment", F.lit(segment)), path)


def write_index(pages: DataFrame, path: str, uses: tuple[str, ...] = (RANKED, GRAMS)) -> None:
    """A new index at ``path``, of one segment."""
    add_to_index(pages, path, uses)


def drop_from_index(targets: DataFrame, path: str) -> None:
    """Forget ``targets`` (technology, version; a null version means all of them)."""
    held = live(targets.sparkSession, path).alias("p")
    same = (F.col("p.technology") == F.col("t.technology")) & (F.col("t.version").isNull() | (F.col("p.version") == F.col("t.version")))
    _commit(held.join(targets.alias("t"), same, "left_semi").select(*KEYS, F.lit(None).cast("string").alias("segment")), path)


def merge_index(spark: SparkSession, path: str) -> None:
    """Rewrite what is live as one segment, and delete the segments before it; no reader may be at work on these."""
    before = [r["segment"] for r in _log(spark, path).select("segment").distinct().where("segment is not null").collect()]
    segment = f"s{uuid.uuid4().hex}"
    uses = _uses(spark, path)
    pages = _live_rows(spark, path, "titles").count() if RANKED in uses else substring.BLOCK * read_grams(spark, path).select(*KEYS, "block").distinct().count()
    kept = lambda table, use: _live_by_part(spark, path, table, 1 + pages // PAGES_A_WRITER) if use in uses else None
    _write_segment(kept("postings", RANKED), kept("titles", RANKED), kept("grams", GRAMS), None, path, segment)
    _commit(live(spark, path).select(*KEYS).withColumn("segment", F.lit(segment)), path)
    for old in before:
        for table in TABLES:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/segment={old}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _table(spark: SparkSession, path: str, table: str, parts: list[int] | None = None) -> DataFrame:
    """A table of all segments, live or not; of ``parts`` alone only their folders are listed."""
    reader = spark.read.schema(f"{COLUMNS[table]}, segment string, part int")
    if parts is None:
        return reader.parquet(f"{path}/{table}")
    folders = f"{path}/{table}/segment=*/part={{{','.join(map(str, parts))}}}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], f"{COLUMNS[table]}, segment string, part int")
    return reader.option("basePath", f"{path}/{table}").parquet(folders)


def _live_rows(spark: SparkSession, path: str, table: str, parts: list[int] | None = None) -> DataFrame:
    return _table(spark, path, table, parts).join(live(spark, path), [*KEYS, "segment"], "left_semi")


def _live_by_part(spark: SparkSession, path: str, table: str, writers: int) -> DataFrame:
    """What is live of a table, each part in ``writers`` tasks: segments have the same parts, so none is dealt anew.

    Two tasks at least, as Spark puts a union of single partitions into one task.
    """
    each = [_table(spark, path, table, [part]).coalesce(max(2, writers)) for part in range(PARTS)]
    return reduce(DataFrame.unionByName, each).join(live(spark, path), [*KEYS, "segment"], "left_semi").drop("segment", "part")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return rows_of(_live_rows(spark, path, "postings"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return _live_rows(spark, path, "titles")


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return _live_rows(spark, path, "grams")


def read_levels(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """The levels of segments of which a version is live; replaced pages may keep a level above the largest weight left."""
    return _table(spark, path, "levels", parts).join(live(spark, path).select("segment"), "segment", "left_semi")


def of_phrase(text: str) -> tuple[str, ...]:
    """The terms of a phrase in their places; stop words have marked ones."""
    return tuple(f"={w}" if w in STOP else stem_word(w) for w in words_of(text))


def parse(query: str) -> dict[str, list]:
    """The parts of a search string: ``all``, each a choice of items, and ``none``, items that must not occur.

    An item is a term, or a tuple of terms in order (a phrase). Bare words are all required, ``a or b`` is a choice,
    ``-`` forbids what follows it and quotes bind words in order; both stand before and between quotes too.
    """
    out: dict[str, list] = {"all": [], "none": []}
    choice = False
    for minus, quoted, bare in re.findall(r'(-?)"([^"]*)"|(\S+)', query.lower()):
        if bare == "or":
            choice = bool(out["all"])
            continue
        forbids = bool(minus) or bare.startswith("-")
        if bare:
            items: list = [stem_word(w) for w in words_of(bare) if w not in STOP]
        else:
            phrase = of_phrase(quoted)
            items = [phrase] if len(phrase) > 1 or (phrase and phrase[0].startswith("=")) else list(phrase)
        if forbids:
            out["none"] += items
        elif choice and items:
            out["all"][-1] += items
        else:
            out["all"] += [[t] for t in items]
        choice = False
    # what is asked for twice is asked for once
    out["all"] = [list(c) for c in dict.fromkeys(tuple(dict.fromkeys(c)) for c in out["all"])]
    out["none"] = list(dict.fromkeys(out["none"]))
    return out


def terms_of(items: list) -> list[str]:
    """The terms of items, each once, those of phrases included."""
    return list(dict.fromkeys(t for item in items for t in ((item,) if isinstance(item, str) else item)))


def _begins(term: str, field: str, place: int) -> Column:
    """Where a phrase would begin, by the positions of the term at that place in it."""
    held = F.filter("p", lambda x: (x["term"] == term) & (x["field"] == field))
    return F.transform(F.flatten(F.transform(held, lambda x: x["at"])), lambda a: a - place)


def _holds(item: str | tuple[str, ...]) -> Column:
    """Whether a page, whose postings are in ``p``, holds an item."""
    if isinstance(item, str):
        return F.exists("p", lambda x: x["term"] == item)
    found = F.lit(False)
    for field in ("A", "B"):
        begins = _begins(item[0], field, 0)
        for place, term in enumerate(item[1:], 1):
            begins = F.array_intersect(begins, _begins(term, field, place))
        found = found | (F.size(begins) > 0)
    return found


def _hits(rows: DataFrame, tree: dict[str, list]) -> DataFrame:
    """Pages that a query asks for, with ``score`` (rounded to 6 places), from the postings of its terms."""
    positive = [item for choice in tree["all"] for item in choice]
    scored = [t for t in terms_of(positive) if not t.startswith("=")]
    placed = terms_of([item for item in positive + tree["none"] if not isinstance(item, str)])
    # positions go along for the terms of phrases alone
    at = F.when(F.col("term").isin(placed), F.col("positions")).otherwise(F.array().cast("array<int>"))
    weights = F.sum(F.when(F.col("term").isin(scored), weight()).otherwise(0.0))
    hits = rows.groupBy(*PAGE, "words").agg(weights.alias("weight"), F.collect_list(F.struct("term", "field", at.alias("at"))).alias("p"))
    for choice in tree["all"]:
        met = F.lit(False)
        for item in choice:
            met = met | _holds(item)
        hits = hits.where(met)
    for item in tree["none"]:
        hits = hits.where(~_holds(item))
    return hits.select(*PAGE, F.round(F.col("weight") / (1 + F.ln(1 + F.col("words"))), 6).alias("score"))


def _bands(levels: DataFrame, tree: dict[str, list]) -> list[tuple[float, int, int]]:
    """(best score possible, band, postings) of the bands that may hold a hit, the most promising first.

    A few rows for each term of the query reach the driver: fields times bands (some 60) times live segments.
    """
    positive = [item for choice in tree["all"] for item in choice]
    held: dict[int, dict[tuple[str, str], float]] = {}
    shortest: dict[int, int] = {}
    rows: dict[int, int] = {}
    for r in of_keys(levels, terms_of(positive + tree["none"])).select("term", "field", "band", "rows", "most", "shortest").collect():
        most = held.setdefault(r["band"], {})
        most[r["term"], r["field"]] = max(r["most"], most.get((r["term"], r["field"]), 0.0))
        shortest[r["band"]] = min(r["shortest"], shortest.get(r["band"], r["shortest"]))
        rows[r["band"]] = rows.get(r["band"], 0) + r["rows"]
    scored = {t for t in terms_of(positive) if not t.startswith("=")}
    out = []
    for band, most in held.items():
        terms = {term for term, _ in most}
        if all(any(terms.issuperset(terms_of([item])) for item in choice) for choice in tree["all"]):
            bound = sum(w for (term, _), w in most.items() if term in scored) / (1 + math.log(1 + shortest[band]))
            out.append((bound, band, rows[band]))
    return sorted(out, reverse=True)


#: Postings that the first round of a search reads at least; each later round reads at least four times as many.
ROWS_A_ROUND = 1_000_000


def best_pages(rows: DataFrame, levels: DataFrame, tree: dict[str, list], limit: int, rows_a_round: int = ROWS_A_ROUND) -> tuple[list[Row], int, int]:
    """The ``limit`` best pages as rows, the postings grouped for them, and the postings of the query's terms in bands that could hold a hit.

    Bands are read by their best possible scores; once that of the next is below the last page had, the others
    cannot change the result, which is the same as that of reading all.
    """
    left = _bands(levels, tree)
    total, read, best = sum(n for _, _, n in left), 0, []
    first = lambda r: (-r["score"], *[(r[c] is not None, r[c]) for c in PAGE])
    while left:
        taken, had = [], 0
        while left and had < rows_a_round:
            _, band, n = left.pop(0)
            taken.append(band)
            had += n
        top = _hits(rows.where(F.col("band").isin(taken)), tree).orderBy(F.col("score").desc(), *PAGE).limit(limit)
        best, read = sorted(best + top.collect(), key=first)[:limit], read + had
        # scores are rounded to 6 places
        if left and len(best) == limit and best[-1]["score"] > left[0][0] + 2e-6:
            break
        rows_a_round *= 4
    return best, read, total


def _scope(technology: str | None, version: str | None) -> Column:
    scope = F.lit(True)
    for name, value in (("technology", technology), ("version", version)):
        scope = scope & (F.col(name) == value) if value is not None else scope
    return scope


def _asked(tree: dict[str, list]) -> list[str]:
    return terms_of([item for choice in tree["all"] for item in choice] + tree["none"])


def ranked(index: DataFrame, pages: DataFrame, query: str, limit: int = 20, technology: str | None = None, version: str | None = None) -> DataFrame:
    """The best pages with ``score`` (rounded to 6 places); ties in store order. A query without a positive part finds nothing.

    ``technology`` and ``version`` narrow the search. All postings of the query's terms are read and grouped, and titles
    come from ``pages``; ``search_index`` does less for the same rows.
    """
    tree, scope, order = parse(query), _scope(technology, version), [F.col("score").desc(), *PAGE]
    rows = of_keys(index, _asked(tree)).where(scope & F.lit(bool(tree["all"])))
    top = _hits(rows, tree).orderBy(*order).limit(max(1, min(100, limit)))
    return pages.where(scope).select(*PAGE, "title").join(F.broadcast(top), PAGE).select(*PAGE, "title", "score").orderBy(*order)


def search_index(spark: SparkSession, path: str, query: str, limit: int = 20, technology: str | None = None, version: str | None = None, rows_a_round: int = ROWS_A_ROUND) -> DataFrame:
    """The rows of ``ranked`` from a stored index: parts of the query's terms, read by bands up to the one that cannot matter.

    The winners (at most 100) are on the driver; their titles are looked up in the parts that hold them.
    """
    tree, order = parse(query), [F.col("score").desc(), *PAGE]
    winners: list[Row] = []
    if tree["all"]:
        terms = _asked(tree)
        parts = parts_holding(spark, pa.table({"term": pa.array(terms, pa.string())}))
        rows = rows_of(of_keys(_live_rows(spark, path, "postings", parts), terms).where(_scope(technology, version)))
        winners = best_pages(rows, read_levels(spark, path, parts), tree, max(1, min(100, limit)), rows_a_round)[0]
    types = (pa.string(), pa.string(), pa.int64(), pa.float64())
    kept = pa.table({c: pa.array([r[c] for r in winners], t) for c, t in zip([*PAGE, "score"], types, strict=True)})
    titles = _live_rows(spark, path, "titles", parts_holding(spark, kept.select(PAGE)) or [-1]).select(*PAGE, "title")
    # a limit that all winners are within: a merge of sorted tasks instead of a shuffle by sampled ranges
    return titles.join(F.broadcast(spark.createDataFrame(kept)), PAGE).select(*PAGE, "title", "score").orderBy(*order).limit(100)


def headline(hits: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """A fragment of at most 18 words around each hit's first match, the matches in « »."""
    terms = [t for t in terms_of([item for choice in parse(query)["all"] for item in choice]) if not t.startswith("=")]
    tokens = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    hit = lambda w: stem(F.regexp_replace(F.lower(w), GAP, "")).isin(terms)
    rows = hits.join(pages.select(*PAGE, tokens.alias("t")), PAGE)
    at = F.array_position(F.transform("t", lambda w: hit(w).cast("int")), 1).cast("int")
    part = F.slice("t", F.greatest(F.lit(1), at - 6), 18)
    return rows.select(*PAGE, F.array_join(F.transform(part, lambda w: F.when(hit(w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w)), " ").alias("headline"))
