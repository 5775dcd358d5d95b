"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.cluster import Tables, checkpointed

__all__ = ["NOT_ALNUM", "SPACE", "Tables", "bounded", "checkpointed", "crc32_sql", "let", "split_words", "table"]

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Separator of normalised words: anything that is no letter and no number.
NOT_ALNUM = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row.

    A lambda that names an outer expression computes it again for each element;
    binding it as the element of a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column, separator: str = SPACE) -> Column:
    """Words of text in order, without empty ones; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads at most one row more than that."""
    return df.limit(limit + 1).count() <= limit


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of an ASCII text: two nibbles a byte, the 16-entry table made by the rule of the polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    nibbles = f"list_transform(range(0, 2 * strlen({text})), lambda i: ('0x' || string_split(hex(encode({text})), '')[xor(i, 1) + 1])::BIGINT)"
    return f"xor(list_reduce({nibbles}, lambda a, x: xor(a >> 4, ({table})[(xor(a, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
