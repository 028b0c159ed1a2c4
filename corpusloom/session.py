"""What a session needs: this package's sources on the executors, and files that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Characters of a long text that take part in range bounds.
HEAD = 100


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where a local session (tests) names none, a temporary folder is set; on a cluster that is an error, as
    executors could not see each other's files there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


class Scratch:
    """Tables in the shared folder that go at the end of a ``with`` block, when nothing reads them any more.

    Unlike cached blocks, the files outlive the executors that wrote them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back, which cuts its lineage."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """``Scratch.keep`` for a table that an operator's lazy result reads, and that stays for that reason."""
    return Scratch(df.sparkSession).keep(df)


def number_rows(df: DataFrame, within: list[str], order: list[Column], last: str | None = None, fn: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """``df`` with ``number``: each row's place, from 0, in ``order`` and then the string ``last`` among the rows that agree in ``within``.

    Rows are range-partitioned by all of these columns and a salt (so that equal rows part too), sorted and numbered
    within their partition. Of ``last`` only the first HEAD characters take part in the ranges, whose bounds are
    sampled to the driver; rows that agree in all keys and in so long a head stay in one partition, as a stream. Only a group that goes on from the partition before has an offset: one at most for
    each partition, so that table is broadcast. No group is collected; null keys are a group. ``fn`` changes
    slices on the way, in the same pass, to columns of ``schema``; it keeps rows and keys.
    """
    ship_package(df.sparkSession)
    kept = df.columns
    text = F.col(f"`{last}`") if last else F.lit("")
    salt = F.when(F.coalesce(F.length(text), F.lit(0)) <= HEAD, F.monotonically_increasing_id()).otherwise(-1)
    ranged = df.withColumn("__head", F.left(text, F.lit(HEAD))).withColumn("__salt", salt).repartitionByRange(*within, *order, "__head", "__salt")
    rows = ranged.sortWithinPartitions(*within, *order, *([text] if last else [])).select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, was, n = TaskContext.get().partitionId(), None, 0
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                batch = fn(batch) if fn else batch
                keys = zip(*[batch.column(w).to_pylist() for w in within], strict=True) if within else [()] * batch.num_rows
                places = []
                for key in keys:
                    n, was = (n + 1 if key == was else 0), key
                    places.append(n)
                more = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__part", "__place"])

    names = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    stored = materialise(rows.mapInArrow(run, f"{names}, __part int, __place long"))
    counts = stored.groupBy("__part", *within).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.sum("__rows").over(before)).where("__offset is not null").drop("__rows")
    same = F.col("l.__part") == F.col("r.__part")
    for w in within:
        same = same & F.col(f"l.{w}").eqNullSafe(F.col(f"r.{w}"))
    both = stored.alias("l").join(F.broadcast(offsets).alias("r"), same, "left")
    out = [c for c in stored.columns if c not in ("__part", "__place")]
    return both.select(*[F.col(f"l.`{c}`") for c in out], (F.col("l.__place") + F.coalesce("r.__offset", F.lit(0))).alias("number"))
