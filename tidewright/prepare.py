"""python -m tidewright.prepare FILE SIZES... : a raw table as integer batches, with the configuration that maintains its cover."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import prepare as steps
from tidewright.functions.cluster import Tables, with_position
from tidewright.sources.sinks import write_text
from tidewright.sources.tables import Config, CsvOptions, config_json, letters, read_raw

NULLS = {"remove": "remove", "nulls_first": "first", "nulls_last": "last"}


def load(spark: SparkSession, path: str, sep: str = ",", header: bool = True, nulls: str = "remove", columns: int | None = None, skip_constant: bool = False, convert: bool = False) -> DataFrame:
    """The table without null tokens; on request without constant columns, a sample of its columns, and as dense ranks.

    Without a header, columns without a value are dropped and sampled ones are named anew by letters. Dates are read where
    a format reads a whole column. nulls: "remove" drops rows with any; else they rank first or last.
    """
    df = read_raw(spark, path, sep, header)
    if not header:
        full = {r["column"] for r in steps.distinct_counts(df).where("n_distinct > 0").collect()}  # a row for each column
        df = df.select(*[c for c in df.columns if c in full])
    df = steps.drop_constant(df) if skip_constant else df
    if columns is not None:
        df = steps.sample_columns(df, columns)
        df = df if header else df.toDF(*letters(columns))
    numbers = {c: f"try_cast(`{c}` AS double)" for c in df.columns}
    plain = df.agg(*[(F.count(F.expr(x)) == F.count(c)).alias(c) for c, x in numbers.items()]).first()
    df = df.withColumns({c: F.expr(x) for c, x in numbers.items() if plain[c]})  # numbers are ranked as numbers
    df = steps.infer_dates(df)
    df = df.dropna() if nulls == "remove" else df
    return steps.rank_encode(df, nulls=NULLS[nulls]) if convert else df


def batch_files(df: DataFrame, stem: str, sizes: Sequence[int], out: str, sep: str = ",", rest: bool = False) -> Config:
    """Writes random disjoint batches as delimited files with headers, {stem}_{start}_{end}.csv, and returns their configuration."""
    tables = Tables(df.sparkSession)
    keyed = tables.write(df.withColumn("_key", F.monotonically_increasing_id()))
    dealt = tables.write(steps.batches(keyed, sizes, F.col("_key"), rest=rest).drop("_key"))
    bounds, start = [], 0
    for size in [*sizes, *([max(0, keyed.count() - sum(sizes))] if rest else [])]:
        bounds.append((start, start + size))
        start += size
    paths = [f"{out}/{stem}_{a}_{b}.csv" for a, b in bounds]
    for k, path in enumerate(paths):
        dealt.where(F.col("batch") == k).drop("batch").write.mode("overwrite").option("sep", sep).csv(path, header=True)
    results = [f"{out}/results_{stem}_0_{b}.txt" for _, b in bounds]
    tables.clear()
    return Config(paths[0], tuple(paths[1:]), results[0], tuple(results[1:]), CsvOptions(sep, True))


#: Fixed value: the column in which a feed for other tools names its operations.
ACTION = "::action"
#: Rows of a start table for tools that need one.
START_ROWS = 10


def action_feed(events: DataFrame, operation: str = "event_type", record: str = "articleid") -> DataFrame:
    """A history without updates as a feed of inserts and deletes by value: the operation under its own name, no record ids."""
    out = events.withColumnRenamed(operation, ACTION) if operation in events.columns else events
    return out.drop(record)


def start_and_rest(df: DataFrame, *order: Column, rows: int = START_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first rows of df as a start table, and the rest as its increment."""
    placed = with_position(df, order)
    return placed.where(F.col("_pos") < rows).drop("_pos"), placed.where(F.col("_pos") >= rows).drop("_pos")


def main(arguments: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("file")
    p.add_argument("sizes", nargs="*", type=int, help="rows of each batch")
    p.add_argument("--out", default="samples", help="folder of the batches and the configuration")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--rest", action="store_true", help="one more batch of all remaining rows")
    p.add_argument("--sep", default=",")
    p.add_argument("--null_option", choices=list(NULLS), default="remove")
    p.add_argument("--num-cols", type=int)
    p.add_argument("--convert-int", action="store_true")
    p.add_argument("--skip-constant-cols", action="store_true")
    p.add_argument("--complete", action="store_true", help="the whole table in one, under complete")
    a = p.parse_args(arguments)
    if not a.complete and not a.sizes:
        p.error("sizes of batches, or --complete")
    sep, stem = a.sep.replace("\\t", "\t"), os.path.splitext(os.path.basename(a.file))[0]
    spark = SparkSession.builder.appName("tidewright").getOrCreate()
    df = load(spark, a.file, sep, not a.no_header, a.null_option, a.num_cols, a.skip_constant_cols, a.convert_int)
    if a.complete:
        df.write.mode("overwrite").option("sep", sep).csv(f"{a.out}/complete/{os.path.basename(a.file)}", header=True)
    else:
        write_text(config_json(batch_files(df, stem, a.sizes, a.out, sep, a.rest)), f"{a.out}/{stem}_config.json")


if __name__ == "__main__":
    main()
