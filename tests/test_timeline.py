import random

from pyspark.sql import functions as F

from tests import brute
from tests.test_engine import NAMES, table_of
from tidewright.operators.engine import OdEngine
from tidewright.operators.timeline import insert_stepwise, prefixes


def test_prefixes():
    assert prefixes(0) == [] and prefixes(3) == [1, 2, 3] and prefixes(1000)[:2] == [5, 10] and prefixes(1001)[-1] == 1001
    assert prefixes(7, 3) == [2, 4, 6, 7]


def test_states_inside_a_batch_are_those_of_batches_of_one(spark):
    r = random.Random(6)
    base = [(i, i, i // 2, 3) for i in range(6)]
    more = [(10 + i, *(r.choice((x, r.randrange(9))) for x in (6 + i, 3 + i // 2, 3))) for i in range(9)]
    engine = OdEngine(table_of(spark, base, 3), NAMES[:3])
    states = insert_stepwise(engine, table_of(spark, more, 3), F.col("_tid"), samples=9)
    assert [s.operations for s in states] == list(range(1, 10))
    for s in states:
        rows = [x[1:] for x in base + more[: s.operations]]
        assert s.ods == brute.cover(rows, 3) and s.non_ods == brute.maximal_invalid(rows, 3)
        assert s.highest_id == 9 + s.operations
    assert len({s.ods for s in states}) > 2
    assert engine.ods() == states[-1].ods and engine.rows.count() == 15
    engine.delete(spark.createDataFrame([(x[0],) for x in more], "_tid long"))
    assert engine.ods() == brute.cover([x[1:] for x in base], 3)
    assert insert_stepwise(engine, table_of(spark, [], 3), F.col("_tid")) == []
    assert len(engine.statistics(0, 0)) == 17
