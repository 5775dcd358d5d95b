"""Swaps found and counted without looking at all pairs of rows of a class.

Rows are put in order by class and A and cut into blocks; FANOUT blocks make one of the next level, up to one for a class. Each block
knows the extremes of A and B of its rows. A search carries rows down: a block is entered only if its extremes allow a partner, and
apart from the one block of a level that A's value lies in, an entered block holds a partner. So the work follows the result,
in a hot class and in the empty context too. The lowest blocks carry their rows; what enters the blocks above them is dealt out by
(class, block) into tasks of about TASK_PAIRS pairs, so the pairs are made where the table's rows are, not where the change was read.

Swapped pairs are counted by digits of A's rank: two rows are told apart by the highest digit in which they differ, so each
level counts, inside blocks that agree in the digits above, rows of lesser digits against rows of greater ones by running sums over B.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.cluster import Tables, with_position

#: Rows of a block of the lowest level, and blocks of a block, as powers of two.
LEAF_BITS, FANOUT_BITS = 8, 6
#: Pairs that a task of a search looks at, if blocks allow it: a block above the lowest is one task at least.
TASK_PAIRS = 50_000_000
#: Bits of a digit, and of the ranges of B's rank that running sums are cut into.
DIGIT_BITS, RANGE_BITS = 4, 12


def swapped(one: Column, two: Column, d_one: Column, d_two: Column, same: bool) -> Column:
    """Whether two rows swap on (one, two)."""
    if same:
        return ((one < d_one) & (two > d_two)) | ((one > d_one) & (two < d_two))
    return ((one < d_one) & (two < d_two)) | ((one > d_one) & (two > d_two))


def _match(names: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names], F.lit(True))


class Blocks:
    """The rows of base, in blocks by class and a; b is a itself where only a's values matter."""

    def __init__(self, base: DataFrame, context: Sequence[str], a: str, b: str, tid: str):
        self.classes, self.tables = [f"x{i}" for i in range(len(context))], Tables(base.sparkSession)
        rows = base.select(*[F.col(c).alias(x) for c, x in zip(context, self.classes)], F.col(a).alias("a"), F.col(b).alias("b"), F.col(tid).alias("id"))
        placed = with_position(rows, [F.col(c) for c in (*self.classes, "a")], "_place")
        extremes = [f(F.col(c)).alias(f"{p}_{c}") for c in ("a", "b") for p, f in (("lo", F.min), ("hi", F.max))]
        blocks = placed.groupBy(*self.classes, F.shiftright("_place", LEAF_BITS).alias("block"))
        level = self.tables.write(blocks.agg(*extremes, F.collect_list(F.struct("a", "b", "id")).alias("rows")))
        self.levels = [level]  # the lowest first, with its rows
        while (level.agg(F.max("block")).first()[0] or 0) > 0:
            merged = [f(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for c in ("a", "b") for p, f in (("lo", F.min), ("hi", F.max))]
            level = self.tables.write(level.withColumn("block", F.shiftright("block", FANOUT_BITS)).groupBy(*self.classes, "block").agg(*merged))
            self.levels.append(level)

    def search(self, wanted: DataFrame, may, found) -> DataFrame:
        """delta_id, base_id: pairs for which found(rows) holds; wanted: the classes' columns, d_a, d_b and delta_id.

        may(lo_a, hi_a, lo_b, hi_b): whether a block with these extremes can hold a partner of (d_a, d_b).
        """
        own = [*self.classes, "d_a", "d_b", "delta_id"]
        front, lowest = None, self.levels[0].withColumn("above", F.shiftright("block", FANOUT_BITS))
        enters = may(*(F.col(f"l.{x}") for x in ("lo_a", "hi_a", "lo_b", "hi_b")))
        for level in reversed(self.levels[1:]):
            blocks = level if front is None else level.withColumn("above", F.shiftright("block", FANOUT_BITS))
            one, on = (wanted, F.lit(True)) if front is None else (front, F.col("f.block") == F.col("l.above"))
            joined = one.alias("f").join(blocks.alias("l"), _match(self.classes, "f", "l") & on & enters)
            front = joined.select(*[F.col(f"f.{c}") for c in own], F.col("l.block"))
        if front is None:
            met = wanted.alias("f").join(lowest.alias("l"), _match(self.classes, "f", "l") & enters)
        else:
            front = self.tables.write(front)
            # a partition for each share of the pairs; both sides keep it, however few bytes they are
            tasks = max(self.tables.spark.sparkContext.defaultParallelism, -(-(front.count() << LEAF_BITS + FANOUT_BITS) // TASK_PAIRS))
            front, lowest = front.repartition(tasks, *self.classes, "block"), lowest.repartition(tasks, *self.classes, "above")
            met = front.alias("f").join(lowest.alias("l").hint("merge"), _match(self.classes, "f", "l") & (F.col("f.block") == F.col("l.above")) & enters)
        rows = met.select("f.d_a", "f.d_b", "f.delta_id", F.explode("l.rows").alias("row"))
        return rows.where(found(F.col("row.a"), F.col("row.b"))).select("delta_id", F.col("row.id").alias("base_id"))

    def _wanted(self, delta: DataFrame, context: Sequence[str], a: str, b: str, tid: str) -> DataFrame:
        return delta.select(*[F.col(c).alias(x) for c, x in zip(context, self.classes)], F.col(a).alias("d_a"), F.col(b).alias("d_b"), F.col(tid).alias("delta_id"))

    def swaps(self, delta: DataFrame, context: Sequence[str], a: str, b: str, tid: str, same: bool = True) -> DataFrame:
        d_a, d_b = F.col("d_a"), F.col("d_b")

        def may(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
            before, behind = (hi_b > d_b, lo_b < d_b) if same else (lo_b < d_b, hi_b > d_b)
            return ((lo_a < d_a) & before) | ((hi_a > d_a) & behind)

        return self.search(self._wanted(delta, context, a, b, tid), may, lambda x, y: swapped(x, y, d_a, d_b, same))

    def splits(self, delta: DataFrame, context: Sequence[str], target: str, tid: str) -> DataFrame:
        d_a = F.col("d_a")
        return self.search(self._wanted(delta, context, target, target, tid), lambda lo, hi, *_: (lo != d_a) | (hi != d_a), lambda x, _: x != d_a)


def count_swaps(df: DataFrame, context: Sequence[str], a: str, b: str, same: bool = True) -> DataFrame:
    """context, pairs: how many pairs of rows swap on (a, b) in each class that has some; classes of any size."""
    tables = Tables(df.sparkSession)
    classes = [f"x{i}" for i in range(len(context))]
    cells = tables.write(df.groupBy(*[F.col(c).alias(x) for c, x in zip(context, classes)], F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    # ranks of A and of B (falling, if a swap is a greater B before) over all classes; equal values share one
    rank = lambda column, order, name: with_position(cells.select(*classes, column).distinct(), [*map(F.col, classes), order], name)
    p, q = rank("a", F.col("a"), "p"), rank("b", F.col("b").desc() if same else F.col("b"), "q")
    placed = cells.alias("c").join(p.alias("p"), _match([*classes, "a"], "c", "p")).select("c.*", "p.p").alias("c").join(q.alias("q"), _match([*classes, "b"], "c", "q")).select("c.*", "q.q")
    placed = tables.write(placed.select(*classes, "p", "q", "n"))
    reach = placed.groupBy(*classes).agg(F.min("p").alias("first"), F.max("p").alias("last"))
    # digits from the lowest to the highest in which a class differs
    top = F.floor((F.length(F.bin(F.col("first").bitwiseXOR(F.col("last")))) - 1) / DIGIT_BITS).cast("int")
    levels = reach.where("first < last").select(*classes, F.sequence(F.lit(0), top).alias("levels"))
    spread = placed.alias("c").join(levels.alias("r"), _match(classes, "c", "r")).select("c.*", F.explode("r.levels").alias("level"))
    shift = F.col("level") * DIGIT_BITS
    right = lambda by: F.call_function("shiftright", F.col("p"), by)
    spread = spread.select(*classes, "level", right(shift + DIGIT_BITS).alias("node"), right(shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).alias("digit"), F.shiftright("q", RANGE_BITS).alias("range"), "q", "n")
    group = [*classes, "level", "node"]
    digits = range(1 << DIGIT_BITS)
    # rows of one place of B and one digit are one; ranges of B that stand before count by their sums
    dealt = tables.write(spread.groupBy(*group, "range", "q", "digit").agg(F.sum("n").alias("n")))
    sums = dealt.groupBy(*group, "range").agg(*[F.sum(F.when(F.col("digit") == d, F.col("n")).otherwise(0)).alias(f"s{d}") for d in digits])
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "range", *[F.coalesce(F.sum(f"s{d}").over(before), F.lit(0)).alias(f"s{d}") for d in digits])
    inside = Window.partitionBy(*group, "range").orderBy("q").rangeBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("n")).otherwise(0)).over(inside), F.lit(0)).alias(f"i{d}") for d in digits])
    met = own.alias("o").join(starts.alias("s"), _match([*group, "range"], "o", "s"))
    lesser = sum((F.when(F.col("o.digit") > d, F.col(f"o.i{d}") + F.col(f"s.s{d}")).otherwise(0) for d in digits[:-1]), F.lit(0))
    counted = met.select(*[F.col(f"o.{c}").alias(c) for c in classes], (F.col("o.n") * lesser).alias("pairs"))
    return counted.groupBy(*classes).agg(F.sum("pairs").cast("long").alias("pairs")).where("pairs > 0").select(*[F.col(x).alias(c) for c, x in zip(context, classes)], "pairs")
