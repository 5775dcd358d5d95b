import json

import pytest

from tests.test_engine import BASE, NAMES, texts
from tidewright.__main__ import run
from tidewright.model import constant, parse, trivial
from tidewright.sources.sinks import append_stats, result_path, write_final, write_ods
from tidewright.sources.tables import Config, CsvOptions, config_json, load_config, project, read_changes, read_integers, read_json_lines, read_ods, read_raw

HEADED = CsvOptions(has_header=True)


def put(path, text):
    path.write_text(text)
    return str(path)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_integers(spark, tmp_path):
    plain = put(tmp_path / "plain.csv", "1, 2,3\n\n4,5 ,6\n")
    df = read_integers(spark, plain)
    assert df.columns == ["A", "B", "C"] and values(df) == [(1, 2, 3), (4, 5, 6)]
    named = put(tmp_path / "named.csv", "x;y\n1;2\n")
    assert read_integers(spark, named, CsvOptions(";", True)).columns == ["x", "y"]
    blank = put(tmp_path / "blank.csv", "x,,z\n1,2,3\n")
    assert read_integers(spark, blank, HEADED).columns == ["x", "z", "_c2"]
    assert read_integers(spark, put(tmp_path / "picked.csv", "a,b,c\n1,2,3\n"), CsvOptions(",", True, False, ("c", "a", "q"))).columns == ["a", "c"]
    with pytest.raises(ValueError):
        read_integers(spark, put(tmp_path / "twice.csv", "x,x\n1,2\n"), HEADED)
    with pytest.raises(ValueError):
        read_integers(spark, put(tmp_path / "empty.csv", ""))
    with pytest.raises(ValueError):
        project(df, ["q"])


@pytest.mark.parametrize("text", ["1,x\n", "1,\n", "1,2\n1,2,3\n", "1,2.5\n"])
def test_cells_that_are_no_integer_fail(spark, tmp_path, text):
    with pytest.raises(Exception, match="blank cell|MALFORMED|NumberFormat|unknown operation|FAILED_READ"):
        read_integers(spark, put(tmp_path / "t.csv", text)).collect()


def test_changes(spark, tmp_path):
    feed = CsvOptions(has_header=True, can_have_deletions=True)
    df = read_changes(spark, put(tmp_path / "feed.csv", "op,id,a\nInsert,7,1\n DELETE ,7,1\nupdate,8,2\n"), feed)
    assert values(df.select("_op", "_rid", "a")) == [("insert", 7, 1), ("delete", 7, 1), ("update", 8, 2)]
    for wrong in ("upsert,1,1\n", ",1,1\n", "insert,,1\n", "insert,1,\n"):
        with pytest.raises(Exception, match="blank cell|MALFORMED|NumberFormat|unknown operation|FAILED_READ"):
            read_changes(spark, put(tmp_path / "wrong.csv", "op,id,a\n" + wrong), feed).collect()
    folder = tmp_path / "folder"
    folder.mkdir()
    put(folder / "1.csv", "3\n4\n")
    put(folder / "2.csv", "\n".join(map(str, range(5, 900))))
    assert [r.A for r in read_changes(spark, str(folder)).orderBy("_seq").collect()] == list(range(3, 900))


def test_other_sources(spark, tmp_path):
    raw = read_raw(spark, put(tmp_path / "raw.csv", "a,b\n?,x\nNULL,y\n"))
    assert values(raw) == [(None, "x"), (None, "y")]
    assert read_raw(spark, put(tmp_path / "bare.csv", "1,2\n"), has_header=False).columns == ["A", "B"]
    assert values(read_json_lines(spark, put(tmp_path / "x.json", '{"a": 1}\nno\n'), "a int")) == [(1,)]
    ods = {constant([0], 1), parse("{}: A↑ ~ B↓", NAMES)}
    write_ods(ods, NAMES, str(tmp_path / "out" / "ods.txt"))
    assert read_ods(spark, str(tmp_path / "out" / "ods.txt"), NAMES) == ods
    assert read_ods(spark, put(tmp_path / "odd.txt", "{A}: [] ↦ B\n{Q}: [] ↦ A\nnone\n"), NAMES) == {constant([0], 1)}


def test_configurations(tmp_path):
    text = json.dumps({"data": {"initial": "a.csv"}, "results": {}, "csv": {}, "algo": {"deletionMode": "DeleteOnly", "optimizeBuildOrder": False, "showProgressBar": True, "minMaxCacheThreshold": 3}})
    config = load_config(text)
    assert config.csv == CsvOptions(",", False, False, ()) and config.deletion_mode == "deleteonly"
    assert load_config(put(tmp_path / "c.json", text)) == config == load_config(config_json(config))
    for algo in ({"useBuildOrder": True}, {"disableEfficientUpdates": True}, {"noInvalidTuplesBelow": 3}, {"deletionMode": "sometimes"}):
        with pytest.raises(ValueError):
            load_config(json.dumps({"data": {}, "algo": algo}))
    with pytest.raises(ValueError):
        load_config("{}")
    with pytest.raises(ValueError):
        load_config(json.dumps({"data": {}, "csv": {"canHaveDeletions": True}, "algo": {"deletionMode": "afterinsert"}}))


def table_file(path, rows):
    return put(path, "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_delete_only_run(spark, tmp_path):
    one, two = table_file(tmp_path / "one.csv", BASE[:3]), table_file(tmp_path / "two.csv", BASE[3:] * 2)
    stats = run(spark, Config(one, (two,), deletion_mode="deleteonly", output=str(tmp_path / "out.txt"), stats_path=str(tmp_path / "stats")))
    assert [s["phase"] for s in stats] == ["initial", "delete_0"]
    left = {tuple(map(int, (r["A"], r["B"], r["C"]))) for r in spark.read.csv(str(tmp_path / "out_data.txt"), header=True).collect()}
    assert left == set(BASE[:3])
    assert read_ods(spark, str(tmp_path / "out_delete_0.txt"), NAMES[:3]) == run_cover(spark, BASE[:3])
    # deletes have a file of their own
    for name, n in (("stats", 1), ("stats_delete", 1)):
        written = spark.read.csv(str(tmp_path / name), header=True)
        assert written.count() == n and len(written.columns) == 18


def run_cover(spark, rows):
    from tests.brute import cover

    return cover(rows, 3)


def test_insert_and_after_insert_runs(spark, tmp_path):
    one, two = table_file(tmp_path / "one.csv", BASE[:3]), table_file(tmp_path / "two.csv", [(4, 40, 300), (1, 10, 100)])
    out = str(tmp_path / "out.txt")
    run(spark, Config(one, (two,), deletion_mode="afterinsert", output=out))
    covers = {p: read_ods(spark, str(tmp_path / f"out_{p}.txt"), NAMES[:3]) for p in ("initial", "increment_0", "delete_0")}
    assert covers["initial"] == covers["delete_0"] == run_cover(spark, BASE[:3])
    assert covers["increment_0"] == run_cover(spark, [*BASE[:3], (4, 40, 300), (1, 10, 100)])
    expected = put(tmp_path / "expected.txt", "{A}: [] ↦ B\n")
    run(spark, Config(None, (one,), None, (expected,), output=str(tmp_path / "bare.txt")))
    assert read_ods(spark, str(tmp_path / "bare_initial.txt"), NAMES[:3]) == trivial(3)
    assert "unexpected" in (tmp_path / "bare_increment_0.txt").read_text()


def test_change_feed_run(spark, tmp_path):
    start = put(tmp_path / "start.csv", "insert,1,1,10\ninsert,2,2,20\n")
    feed = put(tmp_path / "feed.csv", "update,1,3,10\ninsert,3,4,5\ndelete,2,2,20\n")
    run(spark, Config(start, (feed,), csv=CsvOptions(can_have_deletions=True), output=str(tmp_path / "out.txt")))
    left = sorted(tuple(map(int, r)) for r in spark.read.csv(str(tmp_path / "out_data.txt"), header=True).collect())
    assert left == [(1, 3, 10), (3, 4, 5)]


def test_sinks(spark, tmp_path):
    assert result_path("a/b.txt", "t.csv", "initial") == "a/b_initial.txt"
    assert result_path(None, "d/t.csv", "initial") == "results/t_initial_results.txt"
    append_stats(spark, [], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    write_final(spark.createDataFrame([(2, 5), (1, 6)], "_tid long, a long"), str(tmp_path / "final"))
    assert [r._tid for r in spark.read.csv(str(tmp_path / "final"), header=True).collect()] == ["1", "2"]
    assert texts(set()) == set()
