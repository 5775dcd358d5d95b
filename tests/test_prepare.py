import random

import pytest

from tidewright import prepare
from tidewright.__main__ import run
from tidewright.sources.tables import load_config, read_integers, read_raw


def test_batches_and_their_run(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(50), r.choice(("x", "y", "?", "Null")), 1, f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/2020") for _ in range(40)]
    (tmp_path / "raw.csv").write_text("n,t,one,day\n" + "".join(",".join(map(str, x)) + "\n" for x in rows))
    out = str(tmp_path / "samples")
    prepare.main([str(tmp_path / "raw.csv"), "10", "5", "--rest", "--convert-int", "--skip-constant-cols", "--null_option", "nulls_last", "--out", out])
    config = load_config(f"{out}/raw_config.json")
    assert config.initial.endswith("raw_0_10.csv") and [p.rpartition("/")[2] for p in config.increments] == ["raw_10_15.csv", "raw_15_40.csv"]
    parts = [[tuple(x) for x in read_integers(spark, p, config.csv).collect()] for p in (config.initial, *config.increments)]
    assert [len(p) for p in parts] == [10, 5, 25]
    ranks = lambda values: {v: k + 1 for k, v in enumerate(sorted(set(values)))}
    days = [x[3][:5] for x in rows]
    kinds = [x[1] if x[1] in "xy" else "~" for x in rows]
    n, t, d = ranks(x[0] for x in rows), ranks(kinds), ranks(days)
    assert sorted(sum(parts, [])) == sorted((n[x[0]], t[k], d[day]) for x, k, day in zip(rows, kinds, days))
    stats = run(spark, load_config(prepare.config_json(prepare.Config(config.initial, config.increments[:1], csv=config.csv, output=f"{out}/cover.txt"))))
    assert [s["phase"] for s in stats] == ["initial", "increment_0"]


def test_whole_tables(spark, tmp_path):
    (tmp_path / "bare.tsv").write_text("3\t\t5\n1\t\t6\n?\t\t7\n")
    prepare.main([str(tmp_path / "bare.tsv"), "--complete", "--no-header", "--sep", "\\t", "--num-cols", "1", "--null_option", "nulls_last", "--out", str(tmp_path)])
    assert read_raw(spark, str(tmp_path / "complete" / "bare.tsv"), "\t").columns == ["A"]
    got = prepare.load(spark, str(tmp_path / "bare.tsv"), "\t", False)
    assert sorted(map(tuple, got.collect())) == [(1.0, 6.0), (3.0, 5.0)]
    assert prepare.load(spark, str(tmp_path / "bare.tsv"), "\t", False, "nulls_first", convert=True).count() == 3
    with pytest.raises(SystemExit):
        prepare.main([str(tmp_path / "bare.tsv")])


def test_feeds_and_start_tables_of_other_tools(spark):
    from pyspark.sql import functions as F

    events = spark.createDataFrame([("insert", "a1", i, -i) for i in range(14)], "event_type string, articleid string, x int, y int")
    feed = prepare.action_feed(events)
    assert feed.columns == ["::action", "x", "y"] and feed.count() == 14 and prepare.action_feed(feed).columns == feed.columns
    start, rest = prepare.start_and_rest(feed, F.col("y"))
    assert sorted(r.x for r in start.collect()) == list(range(4, 14)) and sorted(r.x for r in rest.collect()) == list(range(4))
    assert prepare.start_and_rest(feed.limit(3), F.col("x"))[1].count() == 0
