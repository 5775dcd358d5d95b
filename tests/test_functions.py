"""Preparation, histories, reports and violations against plain Python."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.test_engine import NAMES, frame
from tidewright.functions import history, prepare
from tidewright.model import all_keys, OrderDependency
from tidewright.operators import report, validate, violations
from tidewright.operators.engine import OdEngine, discover


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nulls_are_refused(spark):
    rows = spark.createDataFrame([(0, 1, None), (1, 1, 7), (2, 2, 8)], "_tid long, A int, B int")
    with pytest.raises(ValueError, match="null"):
        discover(rows, ["A", "B"])
    engine = OdEngine(rows.na.fill(0), ["A", "B"])
    with pytest.raises(ValueError, match="null"):
        engine.insert(rows.withColumn("_tid", F.col("_tid") + 10))


def test_ranges_of_all_types(spark, monkeypatch):
    monkeypatch.setattr(validate, "WHOLE", 0)
    r = random.Random(4)
    rows = [(r.randrange(3), f"k{r.randrange(200):03}", r.randrange(5), r.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "x int, s string, b int, f double").selectExpr("x", "s", "b", "f", "date_add(date'2020-01-01', cast(substr(s, 2) as int)) AS d", "cast(f as decimal(9, 4)) AS m")
    for a, at in (("s", 1), ("f", 3)):
        want = {x for x in range(3) for p, q in product([y for y in rows if y[0] == x], repeat=2) if p[at] < q[at] and p[2] > q[2]}
        got = {y.x for y in validate.violating_classes(df, ["x"], a, "b").collect()}
        assert got == want
    bounds = validate.range_bounds(df, ["s", "d", "m", "f", "b"])
    assert all(len(bounds[c]) > 20 for c in "sdmf")
    assert validate.violating_classes(df, ["x"], "d", "b").count() == len({y.x for y in validate.violating_classes(df, ["x"], "s", "b").collect()})


def test_touched_classes_judge_an_insert(spark):
    r = random.Random(5)
    old, new = ([tuple(r.randrange(4) for _ in range(3)) for _ in range(n)] for n in (30, 3))
    df, names = frame(spark, old + new), NAMES[:3]
    rows = validate.touched(df, names, frame(spark, new))
    ods = [OrderDependency(k, c) for k in all_keys(3) for c in range(8) if not c & k.mask and brute.holds(old, k, c)]
    assert validate.broken(df, names, ods, rows) == {od for od in ods if not brute.holds(old + new, od.key, od.context)}


def test_empty_contexts_of_large_changes_are_searched(spark, monkeypatch):
    monkeypatch.setattr(violations, "BROADCAST_CHANGES", 1)
    df = frame(spark, [(1, 2, 3), (2, 1, 3)])
    both = {(0, 1), (1, 0)}
    assert {tuple(r) for r in violations.swap_violators(df, df, [], "A", "B", "_tid").collect()} == both
    assert [r.pairs for r in violations.swap_pairs(df, [], "A", "B").collect()] == [1]
    assert {tuple(r) for r in violations.swap_violators(df, df, ["C"], "A", "B", "_tid").collect()} == both


def test_dates(spark):
    texts = {
        "a": (["2020-01-02T03:04:05Z", None], "%Y-%m-%dT%H:%M:%SZ"), "b": (["Wed, 01 Jan 2020 10:00:00 GMT", "Thu, 02 Jan 2020 10:00:00 GMT"], "%a, %d %b %Y %H:%M:%S %Z"),
        "c": (["03/04/2020", "12/31/2020"], "%m/%d/%Y"), "d": (["31.12.2020", "1.2.2020"], "%d.%m.%Y"), "e": (["2020-12-31", "2020-01-01"], "%Y-%m-%d"),
        "f": (["2020-12-31+01:00", "2020-12-31Z"], "%Y-%m-%d%z"), "g": (["31/12/2020", "01/02/2020"], None), "h": ([None, None], None), "i": (["2020-01-01", "soon"], None),
    }
    df = spark.createDataFrame(list(zip(*[v for v, _ in texts.values()])), ", ".join(f"{c} string" for c in texts))
    assert prepare.date_formats(df) == {c: f for c, (_, f) in texts.items() if f}
    out = prepare.infer_dates(df)
    assert [str(x.c)[:10] for x in out.collect()] == ["2020-03-04", "2020-12-31"] and dict(out.dtypes)["g"] == "string"


def test_preparation(spark):
    df = spark.createDataFrame([("x", "?", "1"), ("y", "NuLL", "1"), ("x", "z", "1")], "a string, b string, c string")
    clean = prepare.null_tokens(df)
    assert values(clean.select("b")) == values(spark.createDataFrame([(None,), (None,), ("z",)], "b string"))
    assert values(prepare.distinct_counts(clean)) == [("a", 2, 0), ("b", 1, 2), ("c", 1, 0)]
    assert prepare.drop_constant(clean).columns == ["a"]
    assert len(prepare.sample_columns(df, 2).columns) == 2 and prepare.sample_columns(df, 2).columns == prepare.sample_columns(df, 2).columns
    assert [r.b for r in prepare.rank_encode(clean, ["b"]).orderBy("b").collect()] == [1, 1, 2]
    assert [r.b for r in prepare.rank_encode(clean, ["b"], "last").orderBy("b").collect()] == [1, 2, 2]
    assert prepare.rank_encode(clean, ["b"], "remove").count() == 1
    with pytest.raises(ValueError):
        prepare.rank_encode(clean, ["b"], "middle")
    parts = prepare.batches(spark.range(10), [3, 4], F.col("id"))
    assert {r.batch: r["count"] for r in parts.groupBy("batch").count().collect()} == {0: 3, 1: 4, 2: 3}
    assert prepare.up_to(prepare.batches(spark.range(10), [3, 4], F.col("id"), rest=False), 1).count() == 7
    one, two = prepare.halves(spark.range(7), F.col("id"))
    assert values(one) == [(0,), (1,), (2,)] and two.count() == 4


def test_names(spark):
    df = spark.createDataFrame([("Template:Infobox_cpu", " A b"), ("infobox  Book", "C"), (None, None), ("Template: Infobox book", "x"), ("my infobox film", "")], "t string, a string")
    out = df.select(history.normal_type(F.col("t")), history.normal_attribute(F.col("a")), history.safe_file_name(F.coalesce("t", F.lit("")))).collect()
    assert [(r[0], r[1]) for r in out] == [("cpu", "_a_b"), ("book", "c"), ("", ""), ("book", "x"), ("my film", "")]
    assert out[1][2] == "infobox_Book"


def states(rows, allowed):
    """What rebuild says, one record after another."""
    out = []
    for record in sorted({r[0] for r in rows}):
        state, known = {}, False
        for at in sorted({r[1] for r in rows if r[0] == record}):
            step, added = {}, False
            for _, _, a, v in sorted((r for r in rows if r[:2] == (record, at) and r[2] in allowed), key=lambda r: (r[2], r[3] is None, r[3] or "")):
                step.setdefault(a, v)
            for a, v in step.items():
                if v is None:
                    state.pop(a, None)
                else:
                    state[a], added = v, True
            if added:
                out.append((record, at, "update" if known else "insert", *(state.get(c) for c in allowed)))
                known = True
            elif known and not state and step:
                out.append((record, at, "delete", *(None for _ in allowed)))
                known = False
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rebuilt_histories(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(6), r.randrange(8), r.choice("abcq"), r.choice([None, None, "1", "2"])) for _ in range(90)]
    df = spark.createDataFrame(rows, "id int, at int, name string, v string")
    assert values(history.rebuild(df, "id", "at", "name", "v", ["a", "b", "c"])) == sorted(states(rows, ["a", "b", "c"]), key=str)


def test_other_histories(spark):
    events = spark.createDataFrame([(1, 1, "insert", "x"), (1, 2, "update", "y"), (1, 3, "delete", None), (2, 1, "insert", "x"), (3, 2, "insert", "q")], "r int, t int, op string, v string")
    assert values(history.final_state(events, "r", ["t"], "op").select("r", "v")) == [(2, "x"), (3, "q")]
    assert values(history.expand_updates(events, "r", ["t"], "op", ["v"]).where("r = 1").select("op", "v")) == [("delete", "x"), ("delete", "y"), ("insert", "x"), ("insert", "y")]
    assert values(history.changed_mask(events, "r", ["t"], ["v"]).select("r", "t", "mask")) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (3, 2, 1)]
    assert history.baseline_inserts(events, ["t", "r"], "op").count() == 2
    assert history.baseline_inserts(events.where("r = 2"), ["t"], "op").count() == 1
    assert values(history.type_counts(events, "op")) == [("delete", 1), ("insert", 3), ("update", 1)]
    assert values(history.attribute_counts(events.select("op", F.array("v").alias("a")), "op", "a").where("n > 1")) == [("insert", "x", 2)]
    assert values(history.dense_ids(events, "op", "r", F.col("r")).where("op = 'insert'").select("r", "id")) == [(1, 0), (2, 1), (3, 2)]
    assert [x.v for x in history.carried_forward(events, "r", ["t"], ["v"]).where("r = 1").orderBy("t").collect()] == ["x", "y", "y"]
    assert [x.op for x in history.in_feed_order(events.where("t = 2"), "t", "op").collect()] == ["insert", "update"]
    stats = spark.createDataFrame([("cpu", {"a": 3}), ("", {"b": 1}), ("none", None)], "infobox_name string, attributes map<string, int>")
    allowed = history.allowed_attributes(stats)
    assert values(allowed) == [("cpu", ["a"]), ("none", [])]
    changes = spark.createDataFrame([("cpu", "a"), ("cpu", "b"), ("none", "a")], "kind string, name string")
    assert values(history.only_allowed(changes, "kind", "name", allowed)) == [("cpu", "a")]


def test_reports(spark):
    log = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 16.0), ("b", 2, 5.0)], "run string, step int, time double")
    assert values(report.rates(log, "run", "step", "time").select("run", "step", "rate")) == [("a", 1, None), ("a", 3, 3.0), ("b", 2, None)]
    points = spark.createDataFrame([("a", 0), ("a", 2), ("b", 9)], "run string, at int")
    assert values(report.as_of(log, points, "run", "step", "time", "at")) == [("a", 0, None), ("a", 2, 10.0), ("b", 9, 5.0)]
    assert values(report.first_run(log, ["step"], "run").select("step", "run")) == [(1, "a"), (2, "b"), (3, "a")]
    assert values(report.last_row(log, ["run"], "step").select("run", "time")) == [("a", 16.0), ("b", 5.0)]
    assert values(report.keep_first(log, ["run"], F.desc("step")).select("run", "step")) == [("a", 3), ("b", 2)]
    assert values(report.relative(log, "step", "run", "time", "a")) == [(1, "a", 1.0), (3, "a", 1.0)]
    assert values(report.ratio_table(log.where("run = 'a'"), log.where("step = 3"), "step", "time")) == [(1, 10.0, None, None, "missing"), (3, 16.0, 16.0, 1.0, "ok")]
    assert math.isclose(report.mean_std(log, ["run"], "time").where("run = 'a'").first().std, 3.0)
    assert values(report.counts_by(log, "step", "run", ["a", "b"])) == [(1, 1, 0), (2, 0, 1), (3, 1, 0)]
    text = F.lit("read: 12.5 done 10 % then 75.5%")
    row = spark.range(1).select(report.metrics_of(text, ["read", "none"])["read"], report.metrics_of(text, ["none"])["none"], report.progress(text)).first()
    assert tuple(row) == (12.5, None, 75.5)
    states = spark.createDataFrame([(True, False, 1.0), (False, True, 1.0), (False, False, None), (False, False, 1.0)], "t boolean, m boolean, v double")
    assert [r[0] for r in states.select(report.status(F.col("t"), F.col("m"), F.col("v"))).collect()] == ["timeout", "oom", "missing", "ok"]
    json = spark.createDataFrame([("x", '[{"name": "a", "time": 1.5}, {"name": "b", "time": 2}, {"name": "a", "time": 3}]')], "run string, j string")
    assert values(report.flatten_metrics(json, "j")) == [("x", "a", 1.5), ("x", "a", 3.0), ("x", "b", 2.0)]
    assert json.select(report.total_time(json, "j", "a")).first()[0] == 4.5
    assert values(report.runs_of(spark.createDataFrame([("d/run7.csv",)], "path string"))) == [("d/run7.csv", "run7")]
    assert report.dimensions(log) == (3, 3)
