"""Incremental ingest: new captures become pages of the store, version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import urls
from corpusloom.operators import extract, search, store
from corpusloom.session import Scratch
from corpusloom.sources.captures import admitted

CAPTURE_SCHEMA = "id long, url string, status int, content_type string, body string, harvested_at timestamp"


#: What the store keeps of a page: when and as which capture it came, so that a later batch can tell what is newer.
STORED = f"{store.PAGE_SCHEMA}, harvested_at timestamp, came long"


def pages_of(captures: DataFrame) -> DataFrame:
    """Store rows of admitted captures: technology and version from the URL, ordinals by id."""
    found = extract.extract_pages(admitted(captures), "harvested_at").where("error is null")
    return found.select(
        urls.name_of(F.col("url")).alias("technology"),
        urls.version_of(F.col("url"), F.col("harvested_at")).alias("version"),
        F.col("id").alias("ordinal"),
        "title",
        "url",
        F.col("markdown").alias("content"),
        "harvested_at",
        F.col("id").alias("came"),
    )


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The versions that ``new`` touches: of each URL the newest capture, whether stored or new, in the order of ids."""
    held = stored.join(new.select(*store.KEYS).distinct(), store.KEYS, "left_semi").select(*new.columns)
    both = held.unionByName(new)
    newest = both.groupBy(*store.KEYS, "url").agg(F.max_by(F.struct(*both.columns), F.struct("harvested_at", "came")).alias("page"))
    return newest.select("page.*").withColumn("ordinal", F.col("came"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, index: str | None = None) -> StreamingQuery:
    """Reads what is new in ``source`` (Parquet captures) and merges it into the versions that ``target`` holds.

    With ``index`` the search index there follows each batch.

    A version may arrive in several batches or runs. A batch that is run again finds its own pages and leaves the same
    store, with ordinals 1 to n.
    """
    stream = spark.readStream.schema(CAPTURE_SCHEMA).parquet(source)

    def save(batch: DataFrame, _: int) -> None:
        with Scratch(batch.sparkSession) as scratch:
            new = scratch.keep(pages_of(batch))
            # the first batch makes the folder; what was stored is read before it is replaced
            new.limit(0).write.mode("append").partitionBy(*store.KEYS).parquet(target)
            stored = batch.sparkSession.read.schema(STORED).parquet(target)
            whole = scratch.keep(merged(stored, new))
            store.save(whole, target)
            if index:
                search.add_to_index(store.with_ordinals(whole), index)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
