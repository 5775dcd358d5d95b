"""Comparison of sets of dependencies."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.model import OrderDependency, to_text


@dataclass(frozen=True)
class Comparison:
    correct: frozenset[OrderDependency]
    missing: frozenset[OrderDependency]
    unexpected: frozenset[OrderDependency]

    @property
    def is_valid(self) -> bool:
        return not self.missing and not self.unexpected

    @property
    def summary(self) -> str:
        return f"{len(self.correct)} correct, {len(self.missing)} missing, {len(self.unexpected)} unexpected"

    def report(self, names: Sequence[str]) -> str:
        lines = [self.summary]
        for title, ods in (("missing", self.missing), ("unexpected", self.unexpected)):
            lines += [f"{title}:", *sorted(f"  {to_text(od, names)}" for od in ods)] if ods else []
        return "\n".join(lines)


def compare(found: Iterable[OrderDependency], expected: Iterable[OrderDependency]) -> Comparison:
    f, e = frozenset(found), frozenset(expected)
    return Comparison(f & e, e - f, f - e)


def validate(found: Iterable[OrderDependency], expected: Iterable[OrderDependency], names: Sequence[str]) -> None:
    result = compare(found, expected)
    if not result.is_valid:
        raise AssertionError(result.report(names))


def compare_frames(found: DataFrame, expected: DataFrame, column: str = "od") -> DataFrame:
    """status (correct, missing, unexpected) and the dependency, for tables of dependencies."""
    f, e = (df.select(F.col(column).alias("od")).distinct() for df in (found, expected))
    both = f.withColumn("f", F.lit(True)).join(e.withColumn("e", F.lit(True)), "od", "full_outer")
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("correct")
    return both.select(status.alias("status"), "od")
