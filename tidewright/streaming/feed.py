"""Change feeds as streams: the cover after each micro-batch."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.functions.cluster import with_position
from tidewright.operators.engine import OdEngine


#: Batches between two snapshots.
SNAPSHOTS = 16


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _snapshots(spark: SparkSession, state: str) -> list[int]:
    """The numbers of the batches that have a whole snapshot; -1 is the start."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/snapshot=*/about/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(re.search(r"snapshot=(-?\d+)/", str(f.getPath()))[1]) for f in found)


def maintain(stream: DataFrame, engine: OdEngine, checkpoint: str, state: str, on_batch: Callable[[int, OdEngine], None] | None = None, available_now: bool = True, sequence: str = "_seq", done: int = -1, every: int = SNAPSHOTS) -> StreamingQuery:
    """Applies a stream of changes (_op, _rid, _seq, values) to engine by foreachBatch and starts it.

    A snapshot of the engine is written before the first batch and behind each `every`; each batch is stored under state before it is
    applied. So a new driver goes on from recover(), which reads one snapshot and the batches behind it. Batches up to done, replayed behind
    a failure, are passed over. on_batch sees the number and the engine after each batch.
    """
    if not _snapshots(engine.spark, state):
        engine.save(f"{state}/snapshot={done}")

    def apply(batch: DataFrame, number: int) -> None:
        nonlocal done
        if number <= done:
            return
        batch.write.mode("overwrite").parquet(f"{state}/changes/batch={number}")
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{state}/changes/batch={number}")
        if not stored.isEmpty():
            engine.apply(stored, sequence=sequence)
        done = number
        if (number + 1) % every == 0:
            engine.save(f"{state}/snapshot={number}")
        if on_batch:
            on_batch(number, engine)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recover(spark: SparkSession, state: str, sequence: str = "_seq") -> tuple[OdEngine, int]:
    """The engine behind all batches stored under state, and the last one's number (-1: none); batches behind the last snapshot count as one."""
    last = _snapshots(spark, state)[-1]
    engine = OdEngine.load(spark, f"{state}/snapshot={last}")
    if not _exists(spark, f"{state}/changes"):  # no batch was stored
        return engine, last
    changes = spark.read.option("basePath", f"{state}/changes").parquet(f"{state}/changes").where(F.col("batch") > last)
    newest = changes.agg(F.max("batch")).first()[0]
    if newest is not None:
        placed = with_position(changes, [F.col("batch"), F.col(sequence)], "_place")
        engine.apply(placed.drop(sequence, "batch").withColumnRenamed("_place", sequence), sequence=sequence)
    return engine, last if newest is None else int(newest)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """start, kind, n: events by window of time; works on streams, where events later than `late` are left out by the watermark."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
