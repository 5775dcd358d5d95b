"""What a table keeps about its classes while it changes: the rows themselves, dealt out by class, and their extremes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.cluster import Tables, shared_folder


class ClassIndex:
    """A table in buckets by the class of a context, so that looking up the classes of a change moves the change alone.

    Rows of one bucket are sorted by class; later rows are appended to the same buckets. Nulls of the context are no class here
    (rank-encode them first).
    """

    def __init__(self, base: DataFrame, context: Sequence[str], buckets: int = 64):
        self.context, self.buckets = list(context), buckets
        self.name, self.spark = f"tidewright_{uuid.uuid4().hex}", base.sparkSession
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        self._write(base, "error")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).format("parquet").option("path", self.path).bucketBy(self.buckets, *self.context).sortBy(*self.context).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def insert(self, rows: DataFrame) -> None:
        self._write(rows.select(*self.rows.columns), "append")

    def look_up(self, delta: DataFrame) -> DataFrame:
        """The rows of the table in the class of each row of delta, whose columns are named d_...; the table is not shuffled."""
        d = delta.select([F.col(c).alias(f"d_{c}") for c in delta.columns]).repartition(self.buckets, *[f"d_{c}" for c in self.context])
        rows = self.rows
        return rows.hint("merge").join(d, reduce(lambda x, y: x & y, [rows[c] == d[f"d_{c}"] for c in self.context]))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Layers behind which the state is written anew.
LAYERS = 16


class KeptExtremes:
    """lo, hi and n of b for each value of a in each class, kept while rows come and go.

    The state is a few layers: an insert appends the aggregate of its rows alone, a delete the aggregate, taken anew, of the
    (class, a) it took rows from. A reader merges the layers from the last one taken anew on.
    """

    def __init__(self, rows: DataFrame, context: Sequence[str], a: str, b: str):
        self.keys, self.b = [*context, a], b
        self.tables, self.layers, self.version = Tables(rows.sparkSession), [], 0
        self._put(self._aggregate(rows), anew=True)

    def _aggregate(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.min(self.b).alias("lo"), F.max(self.b).alias("hi"), F.count(F.lit(1)).alias("n"))

    def _put(self, cells: DataFrame, anew: bool) -> None:
        self.version += 1
        self.layers.append(self.tables.write(cells.withColumn("version", F.lit(self.version)).withColumn("anew", F.lit(anew))))
        if len(self.layers) > LAYERS:
            state, old = self.state(), self.tables
            self.tables, self.layers = Tables(old.spark), []
            self._put(state, anew=True)
            old.clear()

    def insert(self, rows: DataFrame) -> None:
        self._put(self._aggregate(rows), anew=False)

    def delete(self, gone: DataFrame, rest: DataFrame) -> None:
        """gone: rows taken away; rest: the table without them, of which only the cells of gone are read again."""
        cells = self.tables.write(gone.select(*self.keys).distinct())
        match = lambda one, two: reduce(lambda x, y: x & y, [one[c].eqNullSafe(two[c]) for c in self.keys])
        again = self._aggregate(rest.join(cells, match(rest, cells), "left_semi"))
        left = cells.join(again, match(cells, again), "left").select(*[cells[c] for c in self.keys], "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
        self._put(left, anew=True)

    def state(self) -> DataFrame:
        """The keys, lo, hi and n of every cell that has rows."""
        merged = reduce(DataFrame.unionByName, self.layers).groupBy(*self.keys).agg(F.collect_list(F.struct("version", "anew", "lo", "hi", "n")).alias("l"))  # at most one of a layer
        since = F.array_max(F.transform(F.filter("l", lambda x: x["anew"]), lambda x: x["version"]))
        live = merged.withColumn("since", F.coalesce(since, F.lit(0))).withColumn("l", F.expr("filter(l, x -> x.version >= since)"))
        field = lambda name: F.transform("l", lambda x: x[name])
        return live.select(*self.keys, F.array_min(field("lo")).alias("lo"), F.array_max(field("hi")).alias("hi"), F.aggregate(field("n"), F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).where("n > 0")
