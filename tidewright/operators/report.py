"""Reports over metric logs of runs: rates, as-of values, tables of averages and ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.cluster import with_before


def flatten_metrics(df: DataFrame, json: str, metrics: str = "array<struct<name:string,time:double>>") -> DataFrame:
    """name and time of each entry of a JSON array of metrics, beside the other columns."""
    entries = F.explode(F.from_json(F.col(json), metrics)).alias("m")
    others = [c for c in df.columns if c != json]
    return df.select(*others, entries).select(*others, "m.*")


def total_time(df: DataFrame, json: str, name: str, schema: str = "array<struct<name:string,time:double>>") -> Column:
    """The sum of the times of the entries of one name in a JSON array."""
    own = F.filter(F.from_json(F.col(json), schema), lambda m: m["name"] == name)
    return F.aggregate(own, F.lit(0.0), lambda a, m: a + m["time"])


def rates(df: DataFrame, run: str, step: str, time: str) -> DataFrame:
    """df with d_step, d_time (differences to the step before in the run) and rate (time for each step); a run may be of any size."""
    out = with_before(df, [run], step, F.struct(F.col(step).alias("s"), F.col(time).alias("t")), "_before")
    out = out.withColumn("d_step", F.col(step) - F.col("_before.v.s")).withColumn("d_time", F.col(time) - F.col("_before.v.t")).drop("_before")
    return out.withColumn("rate", F.col("d_time") / F.nullif(F.col("d_step"), F.lit(0)))


def as_of(log: DataFrame, points: DataFrame, run: str, step: str, value: str, at: str) -> DataFrame:
    """run, at, and the value of the last step at or before each point of the run (null: none, or that step has none).

    Points and log are merged by one sort, so a point joins no more rows than one; a run may be of any size.
    """
    marked = log.select(run, F.col(step).alias("_s"), F.lit(False).alias("_point"), F.col(value).alias("_v")).unionByName(points.select(run, F.col(at).alias("_s"), F.lit(True).alias("_point"), F.lit(None).cast(log.schema[value].dataType).alias("_v")))
    out = with_before(marked, [run], "_s", F.col("_v"), "_before", this=True, mark=~F.col("_point"))
    return out.where("_point").select(run, F.col("_s").alias(at), F.col("_before.v").alias(value))


def runs_of(paths: DataFrame, path: str = "path", pattern: str = r"([^/]+)\.\w+$") -> DataFrame:
    """df with run, the part of a file's path that names its run."""
    return paths.withColumn("run", F.regexp_extract(path, pattern, 1))


def first_run(df: DataFrame, group: Sequence[str], run: str) -> DataFrame:
    """The rows of the least run of each group."""
    least = df.groupBy(*group).agg(F.min(run).alias("_least"))
    return df.join(least, list(group)).where(F.col(run) == F.col("_least")).drop("_least")


def last_row(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    others = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*others), F.col(order)).alias("s")).select(*group, "s.*")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first by order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def status(timeout: Column, memory: Column, value: Column) -> Column:
    """ok, timeout, oom or missing."""
    return F.when(memory, "oom").when(timeout, "timeout").when(value.isNull(), "missing").otherwise("ok")


def ratio_table(one: DataFrame, two: DataFrame, by: str, value: str) -> DataFrame:
    """by, one, two, ratio, status: averages of two systems and their ratio; what two lacks stays, as missing."""
    a = one.groupBy(by).agg(F.avg(value).alias("one"))
    b = two.groupBy(by).agg(F.avg(value).alias("two"))
    out = a.join(b, by, "left").withColumn("ratio", F.col("two") / F.nullif(F.col("one"), F.lit(0.0)))
    return out.withColumn("status", F.when(F.col("two").isNull(), "missing").otherwise("ok"))


def relative(df: DataFrame, by: str, setting: str, value: str, baseline: str) -> DataFrame:
    """by, setting, relative: the mean of each setting over that of the baseline setting of the same group."""
    means = df.groupBy(by, setting).agg(F.avg(value).alias("mean"))
    base = means.where(F.col(setting) == baseline).select(by, F.col("mean").alias("base"))
    return means.join(base, by).select(by, setting, (F.col("mean") / F.nullif(F.col("base"), F.lit(0.0))).alias("relative"))


def mean_std(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of each group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def counts_by(df: DataFrame, group: str, value: str, values: Sequence[str]) -> DataFrame:
    """A column of counts for each value."""
    out = df.groupBy(group).pivot(value, list(values)).count()
    return out.na.fill(0)


def metrics_of(text: Column, names: Sequence[str]) -> dict[str, Column]:
    """The number behind "name:" in a log text, for each name."""
    return {n: F.nullif(F.regexp_extract(text, f"{n}: *([-0-9.eE]+)", 1), F.lit("")).cast("double") for n in names}


def progress(text: Column) -> Column:
    """The last percentage that a log text shows."""
    return F.element_at(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?) ?%"), F.lit(1)), -1).cast("double")


def dimensions(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
