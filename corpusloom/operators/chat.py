"""Chat tables: history windows, transcripts, tool results and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_MESSAGES, MOST_CHARACTERS = 40, 100_000


def history(messages: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """Each conversation's last ``most`` messages; of those the users' and assistants' that are not blank, cut to size."""
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    keys = messages.select("conv_id", "turn").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).select("conv_id", "turn")
    rows = messages.join(keys, ["conv_id", "turn"], "left_semi").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return rows.select("conv_id", "turn", "role", F.left("text", F.lit(MOST_CHARACTERS)).alias("text"))


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, text): a single message as it is; else the earlier ones labelled and the last as ``User:``."""
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    label = lambda m: F.concat(F.when(m["role"] == "assistant", "Assistant: ").otherwise("User: "), m["text"])
    last = F.element_at("m", -1)
    earlier = F.array_join(F.transform(F.slice("m", 1, F.size("m") - 1), label), "\n\n")
    return turns.select("conv_id", F.when(F.size("m") == 1, last["text"]).otherwise(F.concat(earlier, F.lit("\n\nUser: "), last["text"])).alias("text"))


def result_summary(text: Column) -> Column:
    """Whether a tool's result is fine, its length and its first 200 characters."""
    return F.struct((~text.startswith("Error:")).alias("ok"), F.length(text).cast("long").alias("size"), F.left(text, F.lit(200)).alias("head"))


def joined_fragments(pieces: DataFrame, key: str) -> DataFrame:
    """One text for each key, its pieces in the order of ``seq``."""
    rows = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), F.size("p").cast("long").alias("pieces"))
