import random

from tests import brute
from tests.test_engine import BASE, NAMES, frame
from tidewright.operators.engine import OdEngine
from tidewright.streaming.feed import maintain, recover, windowed_counts

SCHEMA = "_op string, _rid long, _seq long, A int, B int, C int"


def test_a_new_driver_goes_on(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    table = dict(enumerate(BASE))
    put([("insert", 10, 0, 4, 40, 300), ("delete", 0, 1, *BASE[0])])
    engine = OdEngine(frame(spark, BASE), NAMES[:3])
    maintain(source(), engine, str(tmp_path / "checkpoint"), state).awaitTermination()
    del table[0]
    table[10] = (4, 40, 300)
    assert engine.ods() == brute.cover(list(table.values()), 3)
    # a driver that knows nothing but the stored state
    again, done = recover(spark, state)
    assert done == 0 and again.ods() == engine.ods()
    put([("update", 10, 0, 9, 9, 9), ("insert", 11, 1, 2, 10, 300)])
    seen = []
    maintain(source(), again, str(tmp_path / "checkpoint"), state, lambda n, e: seen.append(n), done=done).awaitTermination()
    table |= {10: (9, 9, 9), 11: (2, 10, 300)}
    assert seen == [1] and again.ods() == brute.cover(list(table.values()), 3)
    assert recover(spark, state)[0].ods() == again.ods()


def test_a_snapshot_spares_the_batches_before_it(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    engine, table = OdEngine(frame(spark, BASE), NAMES[:3]), dict(enumerate(BASE))
    for k in range(3):
        spark.createDataFrame([("insert", 10 + k, 0, k, 3 - k, k % 2)], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        table[10 + k] = (k, 3 - k, k % 2)
        maintain(spark.readStream.schema(SCHEMA).parquet(feed), engine, str(tmp_path / "checkpoint"), state, done=k - 1, every=2).awaitTermination()
    # the changes before the snapshot are not needed: reading them again would insert known records
    again, done = recover(spark, state)
    assert done == 2 and again.ods() == engine.ods() == brute.cover(list(table.values()), 3)


def test_recovery_without_batches(spark, tmp_path):
    OdEngine(frame(spark, BASE), NAMES[:3]).save(str(tmp_path / "snapshot=-1"))
    engine, done = recover(spark, str(tmp_path))
    assert done == -1 and engine.ods() == brute.cover(BASE, 3)


def test_windows(spark):
    r = random.Random(3)
    rows = [(f"2024-01-0{r.randint(1, 3)} {r.randint(10, 20)}:00:00", r.choice("ab")) for _ in range(40)]
    df = spark.createDataFrame(rows, "at string, kind string").selectExpr("cast(at as timestamp) at", "kind")
    got = {(str(x.start)[:10], x.kind): x.n for x in windowed_counts(df, "at", "kind", "1 day", "1 hour").collect()}
    want = {}
    for at, kind in rows:
        want[at[:10], kind] = want.get((at[:10], kind), 0) + 1
    assert got == want
