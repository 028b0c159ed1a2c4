"""The parts that tables of a stored index are dealt into, by a hash of their key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 16


def part_of(*key: Column) -> Column:
    return F.pmod(F.hash(*key), F.lit(PARTS))


def parts_holding(spark: SparkSession, keys: pa.Table) -> list[int]:
    """The parts of few keys, told without a job (a local relation)."""
    frame = spark.createDataFrame(keys)
    return sorted({r["p"] for r in frame.select(part_of(*[F.col(c) for c in frame.columns]).alias("p")).collect()})


def of_keys(index: DataFrame, keys: list[str], column: str = "term") -> DataFrame:
    """The rows of ``keys``; of a stored index only their parts are read."""
    if "part" in index.columns:
        index = index.where(F.col("part").isin(parts_holding(index.sparkSession, pa.table({column: pa.array(keys, pa.string())}))))
    return index.where(F.col(column).isin(keys))
