"""Preparation of raw tables: null tokens, constant columns, dates, dense ranks, samples and batches."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.cluster import with_position

#: Tokens that stand for null, in any case.
NULL_TOKENS = ("", "?", "null")
#: Date formats in the order in which they are tried, each with Spark's patterns for it.
DATE_FORMATS = {
    "%Y-%m-%dT%H:%M:%SZ": ("yyyy-M-d'T'H:m:s'Z'",),
    "%a, %d %b %Y %H:%M:%S %Z": ("d MMM yyyy H:m:s z",),
    "%m/%d/%Y": ("M/d/yyyy",),
    "%d.%m.%Y": ("d.M.yyyy",),
    "%Y-%m-%d": ("yyyy-M-d",),
    "%Y-%m-%d%z": ("yyyy-M-dXXX", "yyyy-M-dXX"),
}
#: The name of a day before a date says nothing more, and Spark does not read it.
_DAY = r"^\s*(Mon|Tue|Wed|Thu|Fri|Sat|Sun), "
#: Distinct values of a column up to so many are broadcast with their ranks; beyond, the join is dealt out by value.
BROADCAST_VALUES = 500_000


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """df with null for tokens in its text columns, white space around them aside."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.when(~F.lower(F.trim(c)).isin(*tokens), F.col(c)) for c in text})


def distinct_counts(df: DataFrame) -> DataFrame:
    """column, n_distinct (nulls aside), n_null: one pass over all columns.

    Each value is a row (column, value) for the aggregate, so a wide table costs its cells, not a count-distinct expansion
    for each pair of columns.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("column").agg(F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))


def drop_constant(df: DataFrame) -> DataFrame:
    """df without columns of one value or none."""
    kept = {r["column"] for r in distinct_counts(df).where("n_distinct > 1").collect()}
    return df.select(*[c for c in df.columns if c in kept])


def sample_columns(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n columns of df, drawn by a seed, in the order of df."""
    drawn = set(random.Random(seed).sample(df.columns, n))
    return df.select(*[c for c in df.columns if c in drawn])


def _as_date(column: str, name: str) -> Column:
    """The timestamp that a text column says in a format, null where it says none."""
    text = F.col(column)
    if name.startswith("%a"):
        text = F.when(text.rlike(_DAY), F.regexp_replace(text, _DAY, ""))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_FORMATS[name]])


def date_formats(df: DataFrame, formats: Sequence[str] = tuple(DATE_FORMATS)) -> dict[str, str]:
    """For each text column the first format that reads all its values (nulls aside; a column of nulls has none); one job."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    if not text:
        return {}
    count = [F.count(_as_date(c, f)).alias(f"{c}|{i}") for c in text for i, f in enumerate(formats)]
    row = df.agg(*[F.count(c).alias(c) for c in text], *count).first()
    found = {c: next((f for i, f in enumerate(formats) if row[c] and row[f"{c}|{i}"] == row[c]), None) for c in text}
    return {c: f for c, f in found.items() if f}


def infer_dates(df: DataFrame, formats: Sequence[str] = tuple(DATE_FORMATS)) -> DataFrame:
    """df with columns of dates as timestamps."""
    return df.withColumns({c: _as_date(c, f) for c, f in date_formats(df, formats).items()})


def dense_ranks(df: DataFrame, column: str, nulls: str = "first") -> DataFrame:
    """value, rank: the dense ranks from 1 of the distinct values of a column; null ranks first or last."""
    order = F.asc_nulls_first("value") if nulls == "first" else F.asc_nulls_last("value")
    return with_position(df.select(F.col(column).alias("value")).distinct(), [order], "rank").select("value", (F.col("rank") + 1).cast("int").alias("rank"))


def rank_encode(df: DataFrame, columns: Sequence[str] | None = None, nulls: str = "first") -> DataFrame:
    """df with each of the columns as dense ranks. nulls: "first", "last", or "remove" to drop rows with any."""
    columns = list(columns or df.columns)
    if nulls not in ("first", "last", "remove"):
        raise ValueError(f"nulls: {nulls}")
    df = df.dropna(subset=columns) if nulls == "remove" else df
    for c in columns:
        ranks = dense_ranks(df, c, nulls)
        few = ranks.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        df = df.join(F.broadcast(ranks) if few else ranks, F.col(c).eqNullSafe(F.col("value"))).withColumn(c, F.col("rank")).drop("value", "rank")
    return df


def shuffled(df: DataFrame, seed: int, key: Column) -> DataFrame:
    """df with _pos, its place in an order drawn by a seed from a unique key."""
    return with_position(df, [F.xxhash64(F.lit(seed), key), key])


def batches(df: DataFrame, sizes: Sequence[int], key: Column, seed: int = 42, rest: bool = True) -> DataFrame:
    """df with batch: disjoint random batches of the sizes asked for, then the rest (dropped if not asked for)."""
    ends, total = [], 0
    for n in sizes:
        total += n
        ends.append(total)
    out = shuffled(df, seed, key).withColumn("batch", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: F.col("_pos") >= e))).drop("_pos")
    return out if rest else out.where(F.col("batch") < len(sizes))


def up_to(df: DataFrame, batch: int) -> DataFrame:
    """The rows of batches 0 to batch: the cumulative table after it."""
    return df.where(F.col("batch") <= batch)


def halves(df: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first and second half of df by position; the first is the smaller one."""
    placed = with_position(df, order)
    middle = df.count() // 2
    return placed.where(F.col("_pos") < middle).drop("_pos"), placed.where(F.col("_pos") >= middle).drop("_pos")
