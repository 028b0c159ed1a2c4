"""Exact dedup by a 128-bit content hash, in DataFrame functions only.

Texts are equal when they are the same without the characters space, tab, line feed, vertical tab, form feed and carriage
return. Rows are grouped by the MD5 digest of what is left. Of a group the row with the most code points in its
original text stays, then the one with the smallest id. Bytes are compared inside the groups by an aggregation over
(hash, text); a hash that more than one text has is a collision, and its rows are grouped by the text itself.

The choice and the sizes come from narrow rows without texts. Each aggregation is combined before its shuffle, so that
a text that a third of all rows hold costs each task one row; the join back on the hash is one that adaptive execution
can split.

Defined cases: a null text is empty, and all empty texts are equal; a null id comes after all others; rows that repeat
an id and a text are rows of their own, of which one stays; long texts are hashed and compared whole; an empty table
gives an empty result; columns other than the named ones are ignored by ``classes`` and stay in ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, with_names

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _choice(rows: DataFrame, *keys: str) -> DataFrame:
    """The row that stays of each group and the group's size."""
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("salt").alias("salt"))
    return rows.groupBy(*keys).agg(F.min(order).alias("lead"), F.count("*").alias("size"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row: ``id``, ``n`` (code points), ``keep`` (id of the row that stays), ``size``, ``kept``, ``sha256`` of the normalised text."""
    docs = with_names(docs, id=id_col, text=text_col)
    text = F.col("text")
    whole = docs.select("id", F.coalesce(F.length(text), F.lit(0)).alias("n"), normalised(text).alias("norm"), F.monotonically_increasing_id().alias("salt"))
    hashed = whole.withColumn("h", digest(F.col("norm")))
    # written once, so that a row's salt is the same wherever it is read
    narrow = materialise(hashed.select("h", "id", "n", "salt", F.sha2("norm", 256).alias("sha256")))
    found = narrow.join(_choice(narrow, "h"), "h")
    collided = materialise(hashed.select("h", "norm").distinct().groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    if not collided.isEmpty():
        doubtful = materialise(hashed.join(collided, "h", "left_semi"))
        apart = doubtful.join(_choice(doubtful, "h", "norm"), ["h", "norm"]).withColumn("sha256", F.sha2("norm", 256))
        found = found.join(collided, "h", "left_anti").unionByName(apart.select(*found.columns))
    return found.select("id", "n", F.col("lead.id").alias("keep"), "size", (F.col("salt") == F.col("lead.salt")).alias("kept"), "sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that go; all columns stay, whatever their names."""
    stays = classes(docs, id_col, text_col).where("kept").select("id", "n", "sha256").alias("r")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n"), F.sha2(normalised(text), 256).alias("sha256")).alias("l")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.n") == F.col("r.n")) & (F.col("l.sha256") == F.col("r.sha256"))
    # a row that repeats, id and all, meets the one that stays more than once
    return rows.join(stays, same).select("l.*").dropDuplicates(["id", "n", "sha256"]).select("row.*")
