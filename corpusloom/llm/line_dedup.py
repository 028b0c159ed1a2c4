"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document are hashed (three hashes of 64 bits, which make one of 64 + 32 bits; windows
are compared by it alone). A window whose hash has an earlier occurrence, by (document id, position), is a later
occurrence; the lines that later occurrences cover are merged and removed. The first occurrence of a window stays.

Defined cases: a null or empty text, and one with fewer lines than a window, stays as it is; windows of blank
lines only do not count; rows that repeat an id and its text are one document and are cut alike; rows that share an
id and not a text are documents of their own, in the order of their texts' hashes; null ids come first in the order;
a text of any length is cut as a whole; an empty table gives an empty result; all columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: str) -> F.Column:
    return F.split(F.col(text), "\n", -1)


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, of, pos) of every later occurrence: the document and the position of a window's first line, from 0.

    ``docs``: id, of (a hash of the text), text. The first occurrences come from an aggregation that is combined before
    its shuffle; a window that a third of all documents hold costs each task one row there, and the join on it can be
    split.
    """
    narrow = docs.select("id", "of", _lines("text").alias("lines")).where(F.size("lines") >= window)
    hashed = narrow.select("id", "of", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("blank"))).alias("h"))
    at = F.sequence(F.lit(0), F.size("h") - window)
    part = lambda i: [F.col("h")[i + k]["h"] for k in range(window)]

    def blank(i):
        out = F.col("h")[i]["blank"]
        for k in range(1, window):
            out = out & F.col("h")[i + k]["blank"]
        return out

    windows = F.transform(at, lambda i: F.when(~blank(i), F.struct(F.xxhash64(*part(i)).alias("h1"), F.hash(*part(i)).alias("h2"))))
    each = hashed.select("id", "of", F.posexplode(windows).alias("pos", "w")).where("w is not null").select("id", "of", "pos", "w.h1", "w.h2")
    first = each.groupBy("h1", "h2").agg(F.min(F.struct("id", "of", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(first, ["h1", "h2"]).where(F.struct("id", "of", "pos") > F.col("first")).select("id", "of", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, count_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines gone from the text; ``count_col``: a further column for how many lines went."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))
    covered = later_windows(rows.select("id", "of", "text"), window).groupBy("id", "of").agg(F.collect_set("pos").alias("at"))
    # the text goes along once, within its row
    l, r = rows.drop("text").alias("l"), covered.alias("r")
    both = l.join(r, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.of") == F.col("r.of")), "left").select("l.row", "r.at")
    gone = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (window - 1)))))
    # the text is split once: a lambda's variable holds its lines and the places that stay
    parts = F.struct(_lines(f"row.`{text_col}`").alias("lines"), gone.alias("gone"))
    stays = F.transform(F.array(parts), lambda p: F.struct(p["lines"].alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), p["gone"]).alias("at")))
    cut = F.transform(stays, lambda p: F.array_join(F.transform(p["at"], lambda i: F.get(p["lines"], i)), "\n"))[0]
    out = [F.when(F.col("at").isNull(), F.col(f"row.`{c}`")).otherwise(cut).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(count_col))
    return both.select(*out)
