"""Helpers for plans that must hold on a cluster: reliable checkpoints and tables, and global positions without a global task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one where it is unset and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Tables written in the shared folder, which cut lineage: a lost executor costs no work before them."""

    #: Rows of a file of a table whose size is known to be small.
    ROWS = 250_000

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.written = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, written and read again; with rows (at most so many) in files of ROWS, else in as many as df has partitions."""
        self.written += 1
        path = f"{self.root}/{self.written}"
        (df if rows is None else df.coalesce(1 + rows // self.ROWS)).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes all tables; whatever reads them must have been written elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Jobs that a driver submits at once.
AT_ONCE = 8


def at_once[T](jobs: Sequence[Callable[[], T]]) -> list[T]:
    """What jobs give, in order; they are submitted from threads, so small ones do not wait for each other's planning."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(session)(job) if session else job) for job in jobs]]


def ranged(df: DataFrame, order: Sequence[Column], name: str = "_range") -> DataFrame:
    """df dealt out by ranges of the order, with the range's number; checkpointed, since the ranges come from a sample."""
    return checkpointed(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def with_before(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, this: bool = False, mark: Column | None = None) -> DataFrame:
    """df with the value of the row before (or of this one, if `this`) in the order within a group, as a struct (null: none).

    A group may be the whole table: it is dealt out by ranges, a row sees those before it in its range, and what a range ends with
    is carried to those behind it, a row for each range and group. mark: only rows for which it holds have a value to give.
    """
    given = F.struct(value.alias("v")) if mark is None else F.when(mark, F.struct(value.alias("v")))
    parts = ranged(df.withColumn("_given", given), [*map(F.col, by), F.col(order)])
    inside = Window.partitionBy(*by, "_range").orderBy(order, *([F.col("_given").isNull()] if mark is not None else []))
    near = F.last("_given", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0 if this else -1))
    ends = parts.groupBy(*by, "_range").agg(F.max_by("_given", F.when(F.col("_given").isNotNull(), F.col(order))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = ends.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_range").alias("_b_range"), carried.alias("_carried"))
    match = F.col("_range") == F.col("_b_range")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    out = parts.withColumn("_near", near).join(before, match)
    return out.withColumn(name, F.coalesce("_near", "_carried")).drop("_given", "_near", "_carried", "_range", "_b_range", *[f"_b_{c}" for c in by])


def with_position(df: DataFrame, order: Sequence[Column], name: str = "_pos") -> DataFrame:
    """df with its rows' places from 0 in the order given.

    Rows are dealt out by ranges of the order; a task numbers its range, and the sizes of the ranges (a row for each
    task) say where it begins. The ranges are checkpointed, since they come from a sample. Rows alike in order have an
    arbitrary order among themselves; an empty table stays empty.
    """
    parts = ranged(df, order)
    sizes = parts.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_range", before.alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn(name, within - 1).join(F.broadcast(begins), "_range").withColumn(name, F.col(name) + F.col("_begin")).drop("_range", "_begin")
