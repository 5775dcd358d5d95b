"""Sinks: covers, comparison reports, statistics and final tables."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidewright.model import OrderDependency, to_text


def write_ods(ods: Iterable[OrderDependency], names: Sequence[str], path: str) -> None:
    """One dependency a line, sorted; metadata, written by the driver."""
    write_text("".join(f"{line}\n" for line in sorted(to_text(od, names) for od in ods)), path)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def result_path(output: str | None, table: str, phase: str) -> str:
    """Where the result of a phase goes: beside output, by phase, or under results."""
    if output:
        stem, dot, end = output.rpartition(".")
        return f"{stem}_{phase}.{end}" if dot and "/" not in end else f"{output}_{phase}"
    return f"results/{os.path.splitext(os.path.basename(table))[0]}_{phase}_results.txt"


def append_stats(spark: SparkSession, rows: Sequence[Mapping], path: str) -> None:
    """Appends rows of statistics, one for each batch, to a table of delimited files with headers."""
    if rows:
        spark.createDataFrame([dict(r) for r in rows]).coalesce(1).write.mode("append").csv(path, header=True)


def write_json(value: object, path: str) -> None:
    write_text(json.dumps(value, indent=2, sort_keys=True), path)


def write_final(df: DataFrame, path: str, order: str = "_tid") -> None:
    """The table in the order of its ids, in as many files as Spark has ranges."""
    df.orderBy(order).write.mode("overwrite").csv(path, header=True)
