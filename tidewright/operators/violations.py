"""Rows that break a dependency together with rows of a change, difference sets, and deletes by value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.dominance import Blocks, count_swaps, swapped
from tidewright.operators.engine import BROADCAST_CHANGES, small


#: Pairs of a changed row and a row of its class up to which the classes are joined; beyond, blocks of them are searched.
JOINED_PAIRS = 100_000_000


def _match(context: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in context], F.lit(True))


def _renamed(delta: DataFrame) -> DataFrame:
    return delta.select([F.col(c).alias(f"d_{c}") for c in delta.columns])


def _sides(delta: DataFrame, context: Sequence[str]) -> tuple[DataFrame, Column]:
    return small(_renamed(delta)), _match(context)


def _too_many(base: DataFrame, delta: DataFrame, context: Sequence[str]) -> bool:
    """Whether classes must be searched in blocks: the empty context with many changes, or hot classes that many changes are in."""
    if not context:
        return delta.limit(BROADCAST_CHANGES + 1).count() > BROADCAST_CHANGES or base.count() * delta.count() > JOINED_PAIRS
    changed = small(_renamed(delta.groupBy(*context).agg(F.count(F.lit(1)).alias("n"))))
    pairs = base.join(changed, _match(context)).agg(F.sum("d_n")).first()[0]
    return (pairs or 0) > JOINED_PAIRS


def split_violators(base: DataFrame, delta: DataFrame, context: Sequence[str], target: str, tid: str) -> DataFrame:
    """delta_id, base_id: rows of base in the class of a changed row with another value of target.

    The change is the small side, so it is broadcast if its size allows; large changes of large classes are searched for in blocks. The
    result holds the pairs asked for: it is for looking at violations; covers are maintained from aggregates (see engine).
    """
    if _too_many(base, delta, context):
        return Blocks(base, context, target, target, tid).splits(delta, context, target, tid)
    d, same = _sides(delta, context)
    return base.join(d, same & (F.col(target) != F.col(f"d_{target}"))).select(F.col(f"d_{tid}").alias("delta_id"), F.col(tid).alias("base_id"))


def swap_violators(base: DataFrame, delta: DataFrame, context: Sequence[str], a: str, b: str, tid: str, same: bool = True) -> DataFrame:
    """delta_id, base_id: rows of base in the class of a changed row that swap with it on (a, b); see split_violators."""
    if _too_many(base, delta, context):
        return Blocks(base, context, a, b, tid).swaps(delta, context, a, b, tid, same)
    d, in_class = _sides(delta, context)
    return base.join(d, in_class & swapped(F.col(a), F.col(b), F.col(f"d_{a}"), F.col(f"d_{b}"), same)).select(F.col(f"d_{tid}").alias("delta_id"), F.col(tid).alias("base_id"))


def difference_masks(base: DataFrame, delta: DataFrame, context: Sequence[str], target: str, available: Sequence[str]) -> DataFrame:
    """mask, n: the difference sets (over the available columns) of pairs that split target, and how many pairs have each."""
    d, same = _sides(delta, context)
    bits = [F.when(~F.col(c).eqNullSafe(F.col(f"d_{c}")), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(available)]
    pairs = base.join(d, same & (F.col(target) != F.col(f"d_{target}")))
    return pairs.groupBy(reduce(Column.__add__, bits, F.lit(0)).cast("long").alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def minimal_masks(masks: DataFrame) -> DataFrame:
    """The masks that contain no other one; masks are distinct, so few."""
    x, y = masks.select("mask").distinct(), masks.select(F.col("mask").alias("other")).distinct()
    return x.join(small(y), (F.col("mask") != F.col("other")) & (F.col("mask").bitwiseAND(F.col("other")) == F.col("other")), "left_anti")


def delete_by_value(base: DataFrame, deletes: DataFrame, columns: Sequence[str], tid: str) -> DataFrame:
    """The ids to delete: the k-th delete of a value takes the row of the k-th highest id with that value."""
    rank = lambda df, order: df.withColumn("_k", F.row_number().over(Window.partitionBy(*columns).orderBy(order)))
    wanted = rank(deletes.select(*columns), F.lit(0)).select([F.col(c).alias(f"d_{c}") for c in [*columns, "_k"]])
    wanted_values = wanted.select(*[F.col(f"d_{c}") for c in columns]).distinct()
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in columns])
    near = base.select(tid, *columns).join(small(wanted_values), match, "left_semi")  # only values that are deleted are ranked
    return rank(near, F.desc(tid)).join(wanted, match & (F.col("_k") == F.col("d__k")), "left_semi").select(tid)


def min_max_clusters(df: DataFrame, context: Sequence[str], a: str, b: str) -> DataFrame:
    """context, a, lo, hi, n: the extremes of b at each value of a in each class."""
    return df.groupBy(*context, a).agg(F.min(b).alias("lo"), F.max(b).alias("hi"), F.count(F.lit(1)).alias("n"))


def clusters_to_check(df: DataFrame, delta: DataFrame, context: Sequence[str], a: str, b: str, tid: str, same: bool = True) -> DataFrame:
    """delta_id, a, lo, hi: the clusters that can hold a swap with a changed row; the others need no look at their rows."""
    d, in_class = _sides(delta, context)
    below, above = (F.col("hi") > F.col(f"d_{b}"), F.col("lo") < F.col(f"d_{b}")) if same else (F.col("lo") < F.col(f"d_{b}"), F.col("hi") > F.col(f"d_{b}"))
    found = ((F.col(a) < F.col(f"d_{a}")) & below) | ((F.col(a) > F.col(f"d_{a}")) & above)
    return min_max_clusters(df, context, a, b).join(d, in_class & found).select(F.col(f"d_{tid}").alias("delta_id"), a, "lo", "hi")


def swap_pairs(df: DataFrame, context: Sequence[str], a: str, b: str, same: bool = True) -> DataFrame:
    """context, pairs: how many pairs of rows swap in each class that has some, counted without making the pairs."""
    return count_swaps(df, context, a, b, same)
