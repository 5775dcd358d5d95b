"""Which dependencies hold on a table, and rows that prove which do not.

Verdicts need no pairs of rows: a constant dependency is a minimum and maximum in each class, a swap
is a running extreme over the smaller values of A against the values at A. Many contexts share one
job (GROUPING SETS), and (context, A) groups are shared by all B.

The running extreme of a class is cut into RANGES ranges of A: extremes of ranges are combined before
rows are looked at, so neither the empty context nor a hot class is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.cluster import at_once
from tidewright.model import Key, OrderDependency, members
from tidewright.plans.lattice import minimal

RANGES = 64
#: Values drawn to find the ranges of a column that is no number.
SAMPLED = 2_000
#: Tables up to so many rows are not cut into ranges.
WHOLE = 200_000
#: Contexts of one GROUPING SETS job at most, since Spark expands each row once for each.
SETS = 12
#: Groups of (context, A) of one job at most, since the table is read for each.
GROUPS = 6


def _names(columns: Sequence[str], mask: int) -> list[str]:
    return [columns[i] for i in members(mask)]


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def range_bounds(df: DataFrame, names: Iterable[str]) -> dict[str, list]:
    """Bounds of the ranges of columns: of numbers approximate quantiles, of other types those of at most about SAMPLED
    distinct values, drawn by their hash. Bounds only say how work is dealt out, never a result; small tables have none."""
    names = list(dict.fromkeys(names))
    if not names or df.limit(WHOLE + 1).count() <= WHOLE:
        return dict.fromkeys(names, [])
    numeric = [c for c in names if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    found = df.stat.approxQuantile(numeric, [i / RANGES for i in range(1, RANGES)], 0.01) if numeric else []
    out = {c: sorted(set(f)) for c, f in zip(numeric, found)}
    others = [c for c in names if c not in numeric]
    if others:
        distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in others]).first()
        for c in others:
            drawn = F.pmod(F.xxhash64(F.lit("range"), c), F.lit(1 + distinct[c] // SAMPLED)) == 0
            values = df.where(F.col(c).isNotNull() & drawn).select(c).distinct().orderBy(c).toPandas()[c].tolist()
            out[c] = [values[i * len(values) // RANGES] for i in range(1, RANGES)] if len(values) >= RANGES else values
            out[c] = list(dict.fromkeys(out[c]))
    return out


def _range(value: Column, bounds: Sequence) -> Column:
    return reduce(Column.__add__, [F.coalesce(value > F.lit(b), F.lit(False)).cast("int") for b in bounds], F.lit(0))


def constant_groups(df: DataFrame, contexts: dict[str, Sequence[str]], targets: Sequence[str]) -> DataFrame:
    """gid, n, and lo_ and hi_ of each target, for each class of each context (name to columns), in one job.

    Nulls are values of their own: rank-encode first if they occur in contexts of several columns.
    """
    columns = list(dict.fromkeys(c for cs in contexts.values() for c in cs))
    sets = [[F.col(c) for c in cs] for cs in contexts.values()]
    inner = [F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{p}_{c}") for c in targets for p, f in (("lo", F.min), ("hi", F.max)))]
    if not columns:
        return df.agg(*inner).withColumn("gid", F.lit(next(iter(contexts))))
    grouped = df.groupingSets(sets, *columns).agg(F.grouping_id().cast("long").alias("g"), *inner)
    width = len(columns)
    codes = {name: sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in cs) for name, cs in contexts.items()}
    gid = reduce(lambda acc, x: acc.when(F.col("g") == x[1], x[0]), codes.items(), F.when(F.lit(False), ""))
    return grouped.withColumn("gid", gid).drop("g")


#: The rows to judge a context on, given the context and all attributes that are judged in it.
Rows = Callable[[int, int], DataFrame]

#: Rows of a change up to so many have their classes broadcast.
BROADCAST_CLASSES = 200_000


def touched(df: DataFrame, columns: Sequence[str], delta: DataFrame, changed: str | None = None) -> Rows:
    """For each context the rows of df in classes that a row of delta is in: a change can break a dependency in these alone.

    changed: a column of delta with the mask of attributes that the row did not have before; rows that changed no attribute that is
    judged are left out. The classes of delta are broadcast if few, so the rest of df is left out where it is scanned.
    """
    few = delta.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES

    def rows(context: int, attributes: int) -> DataFrame:
        names = _names(columns, context)
        own = delta if changed is None else delta.where(F.col(changed).bitwiseAND(F.lit(attributes)) != 0)
        if not names:
            return df
        classes = own.select(*names).distinct()
        return df.join(F.broadcast(classes) if few else classes, names, "left_semi")

    return rows


def constant_verdicts(df: DataFrame, columns: Sequence[str], ods: Iterable[OrderDependency], rows: Rows | None = None) -> set[OrderDependency]:
    """Those of the constant dependencies that do not hold on df, or on the rows of their context (null-free, as rank-encoded tables are)."""
    by_context: dict[int, list[OrderDependency]] = {}
    for od in ods:
        by_context.setdefault(od.context, []).append(od)
    order = sorted(by_context)

    def judge(part: list[int]) -> set[OrderDependency]:
        targets = sorted({od.key.left for m in part for od in by_context[m]})
        names = {str(m): _names(columns, m) for m in part}
        if rows is None:
            groups = constant_groups(df, names, [columns[t] for t in targets])
            verdicts = groups.groupBy("gid").agg(*(F.max(F.col(f"lo_{columns[t]}") != F.col(f"hi_{columns[t]}")).alias(f"v_{t}") for t in targets))
        else:
            own = lambda m: rows(m, m | sum(od.key.mask for od in by_context[m]))
            extremes = lambda m: own(m).groupBy(*names[str(m)]).agg(*(f(columns[t]).alias(f"{p}_{t}") for t in targets for p, f in (("lo", F.min), ("hi", F.max))))
            flags = [F.coalesce(F.max(F.col(f"lo_{t}") != F.col(f"hi_{t}")), F.lit(False)).alias(f"v_{t}") for t in targets]
            verdicts = _union([extremes(m).agg(*flags).select(F.lit(str(m)).alias("gid"), "*") for m in part])
        # a row for each context
        return {od for row in verdicts.collect() for od in by_context[int(row.gid)] if row[f"v_{od.key.left}"]}

    return set().union(*at_once([partial(judge, order[at : at + SETS]) for at in range(0, len(order), SETS)]))


def swap_groups(df: DataFrame, context: Sequence[str], a: str, targets: Sequence[tuple[str, bool]], witness: Column | None = None, bounds: dict[str, list] | None = None) -> DataFrame:
    """For each class and value of a: lo, hi (of each target b) and the extreme of b over smaller values of a.

    targets: (b, same direction). Columns: the context, a, n, lo_b, hi_b, top_b (greatest before) if same, low_b (least
    before) if not. With a witness (a struct of the row) lo, hi, top and low are structs of b and the witness.
    """
    value = lambda b: F.struct(F.col(b).alias("b"), witness.alias("w")) if witness is not None else F.col(b)
    names = list(dict.fromkeys(b for b, _ in targets))
    bounds = range_bounds(df, [a]) if bounds is None else bounds
    keys = [F.col(c).alias(f"x_{i}") for i, c in enumerate(context)]
    classes = [f"x_{i}" for i in range(len(context))]
    groups = df.groupBy(*keys, F.col(a).alias("a")).agg(F.count(F.lit(1)).alias("n"), *(f(value(b)).alias(f"{p}_{b}") for b in names for p, f in (("lo", F.min), ("hi", F.max))))
    if not bounds.get(a):
        running = Window.partitionBy(*classes).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
        pick = [(F.max(f"hi_{b}") if same else F.min(f"lo_{b}")).over(running).alias(f"{'top' if same else 'low'}_{b}") for b, same in dict.fromkeys(targets)]
        return groups.select(*classes, "a", "n", *(f"{p}_{b}" for b in names for p in ("lo", "hi")), *pick)
    groups = groups.withColumn("_part", _range(F.col("a"), bounds[a]))
    inside = Window.partitionBy(*classes, "_part").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*classes).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    extremes = groups.groupBy(*classes, "_part").agg(*(f(f"{p}_{b}").alias(f"{q}_{b}") for b in names for p, q, f in (("hi", "m_top", F.max), ("lo", "m_low", F.min))))
    starts = extremes.select(*[F.col(c).alias(f"s_{c}") for c in classes], F.col("_part").alias("s_part"), *((F.max if q == "top" else F.min)(f"m_{q}_{b}").over(before).alias(f"s_{q}_{b}") for b in names for q in ("top", "low")))
    out = groups.join(starts, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in classes], F.col("_part") == F.col("s_part")))
    pick = []
    for b, same in dict.fromkeys(targets):
        q, p, f, g = ("top", "hi", F.max, F.greatest) if same else ("low", "lo", F.min, F.least)
        pick.append(g(f(f"{p}_{b}").over(inside), F.col(f"s_{q}_{b}")).alias(f"{q}_{b}"))
    return out.select(*classes, "a", "n", *(f"{p}_{b}" for b in names for p in ("lo", "hi")), *pick)


def swap_condition(b: str, same: bool, inner: str = "") -> Column:
    """Whether a group of swap_groups holds the second row of a swap."""
    return F.col(f"top_{b}{inner}") > F.col(f"lo_{b}{inner}") if same else F.col(f"low_{b}{inner}") < F.col(f"hi_{b}{inner}")


def _by_group(ods: Iterable[OrderDependency]) -> dict[tuple[int, int], list[OrderDependency]]:
    """Dependencies by context and, of compatible ones, A (constant ones: -1); each group shares its aggregate."""
    out: dict[tuple[int, int], list[OrderDependency]] = {}
    for od in sorted(set(ods)):
        out.setdefault((od.context, -1 if od.key.constant else od.key.left), []).append(od)
    return dict(sorted(out.items()))


def _attributes(ods: Iterable[OrderDependency]) -> int:
    return reduce(lambda x, od: x | od.context | od.key.mask, ods, 0)


def compatible_verdicts(df: DataFrame, columns: Sequence[str], ods: Iterable[OrderDependency], rows: Rows | None = None, bounds: dict[str, list] | None = None) -> set[OrderDependency]:
    """Those of the compatible dependencies that do not hold on df, or on the rows of their context: one plan for each
    (context, A), shared by all B."""
    by_group = _by_group(ods)
    order = list(by_group)
    bounds = range_bounds(df, [columns[a] for _, a in order]) if bounds is None else bounds

    def judge(part: list[tuple[int, int]]) -> set[OrderDependency]:
        plans = []
        for context, a in part:
            own = by_group[context, a]
            groups = swap_groups(df if rows is None else rows(context, _attributes(own)), _names(columns, context), columns[a], [(columns[od.key.right], od.key.same) for od in own], bounds=bounds)
            flags = [F.coalesce(F.max(swap_condition(columns[od.key.right], od.key.same)), F.lit(False)) for od in own]
            plans.append(groups.agg(F.array(*flags).alias("v")).select(F.lit(context).cast("long").alias("context"), F.lit(a).alias("a"), "v"))
        # a row for each (context, A)
        return {od for row in _union(plans).collect() for od, v in zip(by_group[row.context, row.a], row.v) if v}

    return set().union(*at_once([partial(judge, order[at : at + GROUPS]) for at in range(0, len(order), GROUPS)]))


def broken(df: DataFrame, columns: Sequence[str], ods: Iterable[OrderDependency], rows: Rows | None = None, bounds: dict[str, list] | None = None) -> set[OrderDependency]:
    """Those of ods that do not hold on df, or on what rows (see touched) gives for their context; constants first."""
    ods = set(ods)
    fixed = {od for od in ods if od.key.constant}
    return (constant_verdicts(df, columns, fixed, rows) if fixed else set()) | (compatible_verdicts(df, columns, ods - fixed, rows, bounds) if ods - fixed else set())


Pair = tuple[int, int]


def _proofs(found: DataFrame, *by: str) -> DataFrame:
    """pairs: up to four different pairs (t1, t2) of each group, out of aggregates."""
    ends = F.col("t1").cast("long").alias("t1"), F.col("t2").cast("long").alias("t2")
    pick = [f(F.struct(*order)) for order in (ends, ends[::-1]) for f in (F.min, F.max)]
    straight = [F.struct(p["t1"].alias("t1"), p["t2"].alias("t2")) for p in pick]
    return found.groupBy(*by).agg(F.array_distinct(F.array(*straight)).alias("pairs"))


def witnesses(df: DataFrame, columns: Sequence[str], ods: Iterable[OrderDependency], tid: str = "_tid", rows: Rows | None = None, bounds: dict[str, list] | None = None) -> list[tuple[Key, int, list[Pair]]]:
    """For each broken dependency of ods the distinct difference sets of one pair of rows of each violating class (or
    violating group of it), with the ids of up to four such pairs.

    Pairs come out of aggregates, one for each context (or context and A) and shared by its dependencies; the distinct sets are few.
    """
    row = F.struct(F.col(tid).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    by_group, full = _by_group(ods), (1 << len(columns)) - 1
    order, keys = list(by_group), sorted({od.key for od in ods})
    bounds = range_bounds(df, [columns[a] for _, a in order if a >= 0]) if bounds is None else bounds
    pair = lambda key, w, z, wrong: F.struct(F.lit(keys.index(key)).alias("key"), F.lit(full & ~key.mask).cast("long").alias("free"), w.alias("w"), z.alias("z"), F.coalesce(wrong, F.lit(False)).alias("wrong"))

    def plan(context: int, a: int) -> DataFrame:
        own = by_group[context, a]
        source, names = df if rows is None else rows(context, _attributes(own)), _names(columns, context)
        if a < 0:
            value = lambda t: F.struct(F.col(columns[t]).alias("b"), row.alias("w"))
            groups = source.groupBy(*names).agg(*(f(value(od.key.left)).alias(f"{p}_{od.key.left}") for od in own for p, f in (("lo", F.min), ("hi", F.max))))
            pairs = [pair(od.key, F.col(f"lo_{t}.w"), F.col(f"hi_{t}.w"), F.col(f"lo_{t}.b") != F.col(f"hi_{t}.b")) for od in own for t in [od.key.left]]
        else:
            groups = swap_groups(source, names, columns[a], [(columns[od.key.right], od.key.same) for od in own], row, bounds)
            ends = lambda b, same: (F.col(f"{'top' if same else 'low'}_{b}.w"), F.col(f"{'lo' if same else 'hi'}_{b}.w"), swap_condition(b, same, ".b"))
            pairs = [pair(od.key, *ends(columns[od.key.right], od.key.same)) for od in own]
        found = groups.select(F.explode(F.filter(F.array(*pairs), lambda p: p["wrong"])).alias("p")).select("p.*")
        bits = [F.when(F.col(f"w.v{i}").eqNullSafe(F.col(f"z.v{i}")), F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i in range(len(columns))]
        return found.select("key", reduce(Column.__add__, bits).bitwiseAND(F.col("free")).alias("mask"), F.col("w.t").alias("t1"), F.col("z.t").alias("t2"))

    def collect(part: list[tuple[int, int]]) -> list[tuple[Key, int, list[Pair]]]:
        return [(keys[r.key], r["mask"], [(p.t1, p.t2) for p in r.pairs]) for r in _proofs(_union([plan(*group) for group in part]), "key", "mask").collect()]

    return [x for part in at_once([partial(collect, order[at : at + GROUPS]) for at in range(0, len(order), GROUPS)]) for x in part]


#: Rows that neighbours are looked for in, those that are sorted at once, and difference sets of a key that these give.
SEED_ROWS, SEED_BATCH, SEED_SETS = 160_000, 40_000, 128
#: Rows of a value among those drawn by ids from which on it is not drawn whole.
SEED_CLASS = 1_000


def _vectors(codes: np.ndarray, order: np.ndarray, lag: int) -> np.ndarray:
    """A row for each kind of pair `lag` places apart in an order: where the two differ, where the first is less (masks), and the rows."""
    x, y = order[:-lag], order[lag:]
    differ, less = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for c in range(codes.shape[1]):
        one, two = codes[x, c], codes[y, c]
        differ |= (one != two).astype(np.int64) << c
        less |= (one < two).astype(np.int64) << c
    by = np.lexsort([less, differ])
    new = np.append(True, (np.diff(differ[by]) != 0) | (np.diff(less[by]) != 0)) if len(by) else np.zeros(0, bool)
    return np.stack([differ, less, x, y])[:, by[new]]


def _sets_of(codes: np.ndarray, keys: Sequence[Key]) -> Iterator[tuple[int, int, int, int]]:
    """(key, mask, row, row): the least difference sets of rows that stand beside each other in an order by one column or two."""
    n = codes.shape[1]
    found = []
    for c in range(n):
        for d in range(c, n):
            rest = [(d + k) % n for k in range(n, 0, -1)]
            order = np.lexsort([codes[:, k] for k in (*rest, d, c)])
            found += [_vectors(codes, order, lag) for lag in ((1, 2, 5) if c == d else (1,)) if lag < len(codes)]
    if not found:
        return
    differ, less, x, y = np.concatenate(found, axis=1)
    for k, key in enumerate(keys):
        wrong = differ >> key.left & 1 == 1
        if not key.constant:
            wrong &= (differ >> key.right & 1 == 1) & ((less >> key.left & 1 == less >> key.right & 1) != key.same)
        masks, at = np.unique(differ[wrong] & ~key.mask, return_index=True)
        least = sorted(zip(masks.tolist(), np.flatnonzero(wrong)[at].tolist()), key=lambda m: m[0].bit_count())[: 8 * SEED_SETS]
        kept = minimal(m for m, _ in least)
        for m, i in [p for p in least if p[0] in kept][:SEED_SETS]:
            yield k, m, int(x[i]), int(y[i])


def neighbours(df: DataFrame, columns: Sequence[str], keys: Sequence[Key], tid: str, rows: int) -> list[tuple[Key, int, list[Pair]]]:
    """Difference sets of rows that stand beside each other when a batch of rows is sorted by a column or two.

    They only spare rounds of judgement: every pair is a proof by itself, and what they miss is found where candidates are judged. So
    about SEED_ROWS rows, drawn by a hash of their ids, are enough of a table of `rows`; and of a column whose classes are so small
    that hardly two of their rows are drawn, about as many rows of whole classes, drawn by a hash of its values.
    """

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def sets() -> pd.DataFrame:
            frame = pd.concat(held)
            held.clear()
            ids = frame[tid].to_numpy()
            codes = np.stack([np.unique(frame[c].to_numpy(), return_inverse=True)[1] for c in columns], axis=1)
            return pd.DataFrame([(k, m, int(ids[x]), int(ids[y])) for k, m, x, y in _sets_of(codes, keys)], columns=["key", "mask", "t1", "t2"])

        for frame in frames:
            if len(frame):
                held.append(frame)
            if sum(map(len, held)) >= SEED_BATCH:
                yield sets()
        if held:
            yield sets()

    step, parts = 1 + rows // SEED_ROWS, max(1, min(rows, SEED_ROWS) // SEED_BATCH)
    drawn = lambda by: df.where(F.pmod(F.xxhash64(F.lit("neighbours"), by), F.lit(step)) == 0).select(F.col(tid).cast("long").alias(tid), *columns)
    frames = [drawn(tid).coalesce(parts)]
    if step > 1:
        distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
        for c in columns:
            if 2 * step * distinct[c] > rows:
                large = drawn(tid).groupBy(c).count().where(F.col("count") > SEED_CLASS).select(c)
                frames.append(drawn(c).join(F.broadcast(large), c, "left_anti").select(tid, *columns).repartition(parts, c))
    found = _proofs(_union([f.mapInPandas(find, "key int, mask long, t1 long, t2 long") for f in frames]), "key", "mask")
    return [(keys[r.key], r["mask"], [(p.t1, p.t2) for p in r.pairs]) for r in found.collect()]


def violating_classes(df: DataFrame, context: Sequence[str], a: str, b: str, same: bool = True) -> DataFrame:
    """The classes of a context that hold a swap of a and b."""
    found = swap_groups(df, context, a, [(b, same)]).where(swap_condition(b, same))
    names = [F.col(f"x_{i}").alias(c) for i, c in enumerate(context)]
    return found.select(*names).distinct()


def is_superkey(df: DataFrame, context: Sequence[str]) -> bool:
    """Whether no two rows agree in the context; stops at the first class of two."""
    return df.groupBy(*context).count().where("count > 1").limit(1).isEmpty()


def split_classes(df: DataFrame, context: Sequence[str], target: str) -> DataFrame:
    """The classes in which target has several values (context, lo, hi, n)."""
    return df.groupBy(*context).agg(F.min(target).alias("lo"), F.max(target).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")


def stripped_sizes(df: DataFrame, context: Sequence[str]) -> DataFrame:
    """One row: classes of two rows or more, and the rows in them."""
    return df.groupBy(*context).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_classes"))
