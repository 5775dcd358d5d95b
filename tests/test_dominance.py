import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions.cluster import ranged
from tidewright.operators import classes, dominance, report, violations


def rows_of(spark, seed, n, wide):
    r = random.Random(seed)
    rows = [(f"r{i}", r.randrange(3) if r.random() < 0.9 else 7, r.randrange(wide), r.randrange(wide)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "tid string, x int, a int, b int").repartition(5)


def wrong(s, t, same):
    return (s[2] - t[2]) * (s[3] - t[3]) * (1 if same else -1) < 0


@pytest.mark.parametrize(("context", "same", "wide"), [((), True, 40), (("x",), False, 12), (("x",), True, 1000), ((), False, 3)])
def test_swaps_and_their_counts_against_all_pairs(spark, monkeypatch, context, same, wide):
    monkeypatch.setattr(dominance, "LEAF_BITS", 3)
    monkeypatch.setattr(dominance, "FANOUT_BITS", 2)
    monkeypatch.setattr(dominance, "RANGE_BITS", 2)
    base, df = rows_of(spark, 1, 300, wide)
    delta, changed = rows_of(spark, 2, 12, wide)
    inside = lambda s, t: not context or s[1] == t[1]
    blocks = dominance.Blocks(df, context, "a", "b", "tid")
    assert len(blocks.levels) > 2
    got = sorted(map(tuple, blocks.swaps(changed, context, "a", "b", "tid", same).collect()))
    assert got == sorted((d[0], s[0]) for d in delta for s in base if inside(s, d) and wrong(s, d, same))
    want = {}
    for i, s in enumerate(base):
        for t in base[i + 1 :]:
            if inside(s, t) and wrong(s, t, same):
                want[s[1] if context else None] = want.get(s[1] if context else None, 0) + 1
    counted = {(r.x if context else None): r.pairs for r in dominance.count_swaps(df, context, "a", "b", same).collect()}
    assert counted == want
    splits = sorted(map(tuple, dominance.Blocks(df, context, "a", "a", "tid").splits(changed, context, "a", "tid").collect()))
    assert splits == sorted((d[0], s[0]) for d in delta for s in base if inside(s, d) and s[2] != d[2])


def test_large_changes_of_the_empty_context_are_not_refused(spark, monkeypatch):
    monkeypatch.setattr(violations, "BROADCAST_CHANGES", 5)
    base, df = rows_of(spark, 3, 60, 9)
    delta, changed = rows_of(spark, 4, 20, 9)
    got = sorted(map(tuple, violations.swap_violators(df, changed, [], "a", "b", "tid").collect()))
    assert got == sorted((d[0], s[0]) for d in delta for s in base if wrong(s, d, True))
    got = sorted(map(tuple, violations.split_violators(df, changed, [], "a", "tid").collect()))
    assert got == sorted((d[0], s[0]) for d in delta for s in base if s[2] != d[2])
    empty = df.limit(0)
    assert violations.swap_violators(empty, changed, [], "a", "b", "tid").count() == violations.swap_violators(df, empty, [], "a", "b", "tid").count() == violations.swap_pairs(empty, [], "a", "b").count() == 0


def test_a_class_index_is_not_shuffled(spark):
    base, df = rows_of(spark, 5, 200, 6)
    delta, changed = rows_of(spark, 6, 30, 6)
    index = classes.ClassIndex(df.where("tid <> 'r7'"), ["x", "a"], 4)
    index.insert(df.where("tid = 'r7'"))
    found = index.look_up(changed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    before, scan, _ = plan.partition("Bucketed: true")
    assert scan and "Exchange" not in before, plan
    assert sorted((r.d_tid, r.tid) for r in found.collect()) == sorted((d[0], s[0]) for d in delta for s in base if d[1:3] == s[1:3])
    index.drop()


def test_kept_extremes_follow_random_changes(spark, monkeypatch):
    monkeypatch.setattr(classes, "LAYERS", 3)
    r = random.Random(8)
    schema = "tid long, x int, a int, b int"
    row = lambda i: (i, r.choice((None, 1, 2)), r.randrange(4), r.randrange(50))
    table = {i: row(i) for i in range(30)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    kept, top = classes.KeptExtremes(frame(table.values()), ["x"], "a", "b"), 30
    for _ in range(5):
        more = {i: row(i) for i in range(top, top + 5)}
        top += 5
        kept.insert(frame(more.values()))
        table |= more
        gone = [table.pop(i) for i in r.sample(sorted(table), 6)]
        kept.delete(frame(gone), frame(table.values()))
        want = {}
        for _, x, a, b in table.values():
            lo, hi, n = want.get((x, a), (b, b, 0))
            want[x, a] = (min(lo, b), max(hi, b), n + 1)
        assert {(s.x, s.a): (s.lo, s.hi, s.n) for s in kept.state().collect()} == want


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in several ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_one_run_of_all_rows_is_dealt_out(spark, many_ranges):
    r = random.Random(9)
    rows = [("one", i, r.choice((None, float(r.randrange(9))))) for i in r.sample(range(2000), 400)] + [(None, 3, 1.0), (None, 8, 2.0), ("two", 5, None)]
    log = spark.createDataFrame(rows, "run string, step long, value double").repartition(6)
    own = {}
    for run, step, value in sorted(rows, key=lambda x: x[1]):
        own.setdefault(run, []).append((step, value))
    want = []
    for run, steps in own.items():
        for (s0, v0), (s1, v1) in zip([(None, None), *steps], steps):
            d_time = None if v0 is None or v1 is None else v1 - v0
            want.append((run, s1, None if s0 is None else s1 - s0, d_time))
    got = report.rates(log, "run", "step", "value")
    assert sorted(((x.run, x.step, x.d_step, x.d_time) for x in got.collect()), key=str) == sorted(want, key=str)
    points = [("one", 0), ("one", 777), ("one", 778), ("one", 5000), (None, 5), ("two", 4), ("two", 5), ("three", 9)]
    found = report.as_of(log, spark.createDataFrame(points, "run string, at long"), "run", "step", "value", "at")
    last = lambda run, at: next((v for s, v in reversed(own.get(run, [])) if s <= at), None)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((run, at, last(run, at)) for run, at in points), key=str)
    assert ranged(log.where("run = 'one'"), [F.col("run"), F.col("step")]).select("_range").distinct().count() > 1


def test_a_search_is_dealt_out_by_blocks_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(dominance, "LEAF_BITS", 2)
    monkeypatch.setattr(dominance, "FANOUT_BITS", 2)
    base, df = rows_of(spark, 10, 400, 1000)
    delta, changed = rows_of(spark, 11, 5, 1000)
    found = dominance.Blocks(df, [], "a", "b", "tid").swaps(changed.coalesce(1), [], "a", "b", "tid")
    shares = found.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert shares.sum() == sum(wrong(s, d, True) for d in delta for s in base)
    assert len(shares) > 1 and shares.max() < shares.sum() * 0.6  # not all where the change was read
