"""Empty tables, very long texts and columns of clashing names of the operators that other tests do not hold them against."""

import zlib

from tests.llm.test_operators import DOCS, prose, rows
from tidewright.llm import decontaminate, near_dup, sharding

ITEMS = "item_id long, text string"


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, prose(1, 40))], ITEMS)
    assert sharding.shard_documents(none).count() == 0
    assert near_dup.near_duplicates(none).count() == near_dup.one_of_each(none).count() == 0
    assert decontaminate.find_leaks(none, item).count() == decontaminate.without_leaks(none, item).count() == 0
    docs = spark.createDataFrame([(1, prose(1, 40))], DOCS)
    assert decontaminate.find_leaks(docs, item.limit(0)).count() == 0 and decontaminate.without_leaks(docs, item.limit(0)).count() == 1


def test_very_long_texts(spark):
    long, leak = prose(3, 120_000), prose(4, 50)
    texts = {1: long, 2: f"one more word {long}", 3: f"{long[: len(long) // 3]} {leak} {prose(5, 100)}", 4: prose(6, 60)}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    sharded = rows(sharding.shard_documents(docs))
    assert {i: (r.size, r.text_crc32) for i, r in sharded.items()} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    classes = rows(near_dup.near_duplicates(docs))
    assert {i: (r.class_id, r.n_class) for i, r in classes.items()} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(7, leak)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.overlap) for r in found] == [(3, 7, 1.0)]


def test_columns_of_clashing_names(spark):
    names = ["id", "class", "class_id", "n_class", "copy", "bucket", "component", "weight", "bands", "kept", "n", "raw", "least"]
    text = prose(8, 80)
    df = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate([text, text, prose(9, 80), None])], f"{DOCS}, " + ", ".join(f"`{c}` string" for c in names))
    got = rows(near_dup.near_duplicates(df))
    assert {i: (r.class_id, r.n_class) for i, r in got.items()} == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1)}
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.copy) for r in kept.collect()) == [(0, "copy0"), (2, "copy2"), (3, "copy3")]
