import random

import pytest

from tests import brute
from tidewright.model import all_keys, parse, to_text
from tidewright.operators import engine as engine_module
from tidewright.operators import validate as validate_module
from tidewright.operators.compare import compare, validate
from tidewright.operators.engine import OdEngine, discover

NAMES = ["A", "B", "C", "D"]


def frame(spark, rows, n=3, first=0):
    return spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], "_tid long, " + ", ".join(f"{c} int" for c in NAMES[:n]))


def texts(ods, n=3):
    return {to_text(od, NAMES[:n]) for od in ods}


BASE = [(1, 10, 100), (2, 10, 200), (3, 20, 300), (4, 30, 300)]


def test_fixture_increments(spark):
    base = {"{A}: [] ↦ B", "{A}: [] ↦ C", "{B, C}: [] ↦ A", "{}: A↑ ~ B↑", "{}: A↑ ~ C↑", "{}: B↑ ~ C↑"}
    after = {
        ((5, 10, 400), (6, 35, 300)): {"{A}: [] ↦ B", "{A}: [] ↦ C", "{B, C}: [] ↦ A", "{C}: A↑ ~ B↑", "{B}: A↑ ~ C↑"},
        ((4, 40, 300),): {"{A}: [] ↦ C", "{B, C}: [] ↦ A", "{}: A↑ ~ B↑", "{}: A↑ ~ C↑", "{}: B↑ ~ C↑"},
        ((4, 40, 400),): {"{A, B}: [] ↦ C", "{A, C}: [] ↦ B", "{B, C}: [] ↦ A", "{}: A↑ ~ B↑", "{}: A↑ ~ C↑", "{}: B↑ ~ C↑"},
        ((1, 10, 100),): base,
    }
    for added, expected in after.items():
        engine = OdEngine(frame(spark, BASE), NAMES[:3], {parse(t, NAMES[:3]) for t in base})
        engine.insert(frame(spark, added, first=100))
        assert texts(engine.ods()) == expected
        engine.delete(frame(spark, added, first=100).select("_tid"))
        assert texts(engine.ods()) == base
    assert texts(discover(frame(spark, BASE), NAMES[:3])) == base


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = 3 + seed % 2
    row = lambda: tuple(r.randrange(3) for _ in range(n))
    table = {i: row() for i in range(5)}
    engine = OdEngine(frame(spark, [table[i] for i in range(5)], n), NAMES[:n])
    check = lambda: (engine.ods(), engine.non_ods()) == (brute.cover(list(table.values()), n), brute.maximal_invalid(list(table.values()), n))
    assert check()
    added = {10 + i: row() for i in range(3)}
    engine.insert(frame(spark, list(added.values()), n, 10))
    table |= added
    assert check()
    for i in (gone := [1, 3, 11]):
        del table[i]
    engine.delete(spark.createDataFrame([(i,) for i in gone], "_tid long"))
    assert check()
    new, moved = row(), row()
    changes = [("insert", 20, 0, *new), ("update", 0, 1, *row()), ("UPDATE ", 0, 2, *moved), ("delete", 2, 3, *table[2]), ("insert", 21, 4, *new), ("delete", 21, 5, *new)]
    engine.apply(spark.createDataFrame(changes, "_op string, _rid long, _seq long, " + ", ".join(f"{c} int" for c in NAMES[:n])))
    table |= {20: new, 0: moved}
    del table[2]
    assert check()


def test_changes_are_checked(spark):
    engine = OdEngine(frame(spark, BASE), NAMES[:3])
    for op, rid in (("upsert", 1), ("delete", 99), ("insert", 1)):
        with pytest.raises(ValueError):
            engine.apply(spark.createDataFrame([(op, rid, 0, 1, 1, 1)], "_op string, _rid long, _seq long, A int, B int, C int"))
    engine.apply(spark.createDataFrame([("delete", i, i, *BASE[i]) for i in range(4)], "_op string, _rid long, _seq long, A int, B int, C int"))
    assert texts(engine.ods()) == {"{}: [] ↦ A", "{}: [] ↦ B", "{}: [] ↦ C"}
    assert engine.non_ods() == set()


def test_comparison():
    ods = {parse(t, NAMES) for t in ("{A}: [] ↦ B", "{}: A↑ ~ B↑")}
    assert compare(ods, ods).is_valid
    with pytest.raises(AssertionError, match="1 missing"):
        validate(set(), {parse("{A}: [] ↦ B", NAMES)}, NAMES)


def judged_whole(engine):
    return {od for od, whole in engine.judged.items() if whole}


def table_of(spark, rows, n):
    return spark.createDataFrame(rows, "_tid long, " + ", ".join(f"{c} int" for c in NAMES[:n]))


def test_a_set_with_another_pair_starts_no_judgement(spark):
    rows = [(i, i % 3, 7 * i % 5, i) for i in range(12)]
    engine = OdEngine(table_of(spark, rows, 3), NAMES[:3])
    for key, evidence in engine.evidence.items():  # let one pair of each set that has several lose a row
        for mask, own in evidence.pairs.items():
            assert 1 <= len(own) <= engine_module.PROOFS and all(p != p[::-1] for p in own), (key, mask)
    single = {p for e in engine.evidence.values() for own in e.pairs.values() if len(own) == 1 for p in own}
    ends = {t for p in single for t in p}
    free = [r[0] for r in rows if r[0] not in ends] or [rows[0][0]]
    before = {k: set(e.pairs) for k, e in engine.evidence.items()}
    gone = next((t for t in free if all(any(t not in p for p in own) for e in engine.evidence.values() for own in e.pairs.values())), None)
    assert gone is not None
    engine.delete(spark.createDataFrame([(gone,)], "_tid long"))
    assert engine.judged == {} and before == {k: set(e.pairs) for k, e in engine.evidence.items()}
    assert engine.ods() == brute.cover([r[1:] for r in rows if r[0] != gone], 3)


@pytest.mark.parametrize("column", [0, 3])
def test_an_update_judges_only_what_has_the_column(spark, column):
    r = random.Random(column)
    table = {i: tuple(r.randrange(4) for _ in range(4)) for i in range(14)}
    engine = OdEngine(table_of(spark, [(i, *v) for i, v in table.items()], 4), NAMES[:4])
    changes = []
    for k, i in enumerate(r.sample(sorted(table), 3)):
        table[i] = tuple(9 + k if c == column else v for c, v in enumerate(table[i]))
        changes.append(("update", i, k, *table[i]))
    same = next(i for i in table if i not in {c[1] for c in changes})
    changes.append(("update", same, 9, *table[same]))  # changes nothing
    engine.apply(spark.createDataFrame(changes, "_op string, _rid long, _seq long, " + ", ".join(f"{c} int" for c in NAMES[:4])))
    assert engine.ods() == brute.cover(list(table.values()), 4) and engine.non_ods() == brute.maximal_invalid(list(table.values()), 4)
    assert all((od.context | od.key.mask) >> column & 1 for od in engine.judged)


def test_a_snapshot_goes_on(spark, tmp_path):
    r = random.Random(4)
    table = {i: tuple(r.randrange(3) for _ in range(3)) for i in range(8)}
    engine = OdEngine(table_of(spark, [(i, *v) for i, v in table.items()], 3), NAMES[:3])
    engine.save(str(tmp_path))
    again = OdEngine.load(spark, str(tmp_path))
    assert again.ods() == engine.ods() and again.non_ods() == engine.non_ods() and again.judged == {}
    again.delete(spark.createDataFrame([(2,), (5,)], "_tid long"))
    again.insert(table_of(spark, [(9, 1, 2, 0)], 3))
    rest = [v for i, v in table.items() if i not in (2, 5)] + [(1, 2, 0)]
    assert again.ods() == brute.cover(rest, 3)


def test_wrong_ids_are_refused(spark):
    engine = OdEngine(frame(spark, BASE), NAMES[:3])
    with pytest.raises(ValueError, match="known record: 2"):
        engine.insert(table_of(spark, [(2, 1, 1, 1)], 3))
    with pytest.raises(ValueError, match="comes twice"):
        engine.insert(table_of(spark, [(7, 1, 1, 1), (7, 1, 1, 1)], 3))
    with pytest.raises(ValueError, match="unknown record: 77"):
        engine.delete(spark.createDataFrame([(1,), (77,)], "_tid long"))
    assert engine.ods() == brute.cover(BASE, 3)


def pairs_of_rows(spark, n):
    """Two rows a value of A, which differ in C or not: hardly two of them are drawn together by their ids."""
    r = random.Random(4)
    rows = [(i // 2, r.randrange(5), r.randrange(5)) for i in range(n)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(r.sample(rows, n))], "_tid long, A int, B int, C int").repartition(3)


@pytest.mark.parametrize("hot", [0, 3000])
def test_seeds_have_rows_of_small_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(validate_module, "SEED_ROWS", 100)
    monkeypatch.setattr(validate_module, "SEED_BATCH", 50)
    monkeypatch.setattr(validate_module, "SEED_CLASS", 4, raising=False)
    df = pairs_of_rows(spark, 20_000).selectExpr("_tid", f"CASE WHEN _tid < {hot} THEN -1 ELSE A END AS A", "B", "C")
    rows = {r[0]: tuple(r)[1:] for r in df.collect()}
    found = validate_module.neighbours(df, NAMES[:3], all_keys(3), "_tid", len(rows))
    for key, mask, pairs in found:
        for one, two in pairs:  # every pair is a proof
            differ = sum(1 << i for i, (x, y) in enumerate(zip(rows[one], rows[two])) if x != y)
            assert differ & key.mask == key.mask and differ & ~key.mask == mask
    assert any(key.constant and key.left == 2 and not mask & 1 for key, mask, _ in found)  # agrees in A, differs in C


def test_a_large_start_is_judged_once(spark, monkeypatch):
    monkeypatch.setattr(validate_module, "SEED_ROWS", 400)
    monkeypatch.setattr(validate_module, "SEED_BATCH", 200)
    df = pairs_of_rows(spark, 20_000)
    engine = OdEngine(df.where("_tid % 97 <> 0").selectExpr("_tid", "_tid AS A", "A AS B", "B AS C", "C AS D"), NAMES)
    assert engine.counts["broken"] == 0  # no candidate of the seeds had to be refuted on the whole table
    engine.insert(df.where("_tid % 97 = 0").selectExpr("_tid", "_tid AS A", "A AS B", "B AS C", "C AS D"))
    assert {to_text(od, NAMES) for od in engine.ods()} == {f"{{A}}: [] ↦ {c}" for c in "BCD"}


def test_changes_of_a_large_table_are_judged_once(spark, monkeypatch):
    """An insert and a delete, as cover_after_changes makes them: nothing is refuted on the whole table."""
    monkeypatch.setattr(validate_module, "SEED_ROWS", 400)
    monkeypatch.setattr(validate_module, "SEED_BATCH", 200)
    df = pairs_of_rows(spark, 20_000).selectExpr("_tid", "_tid AS A", "A AS B", "B AS C", "C AS D")
    engine = OdEngine(df.where("_tid % 97 <> 0"), NAMES)
    engine.insert(df.where("_tid % 97 = 0"))
    engine.delete(df.where("_tid % 89 = 0").select("_tid"))
    assert engine.counts["broken"] == 0
    assert {to_text(od, NAMES) for od in engine.ods()} == {f"{{A}}: [] ↦ {c}" for c in "BCD"}
