"""The log-likelihood ratio against counts made one by one."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose, rows
from tidewright.llm import quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text):
    own = words(text)
    return [(w,) for w in own] + list(zip(own, own[1:]))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    texts = {i: prose(i, r.randint(40, 120)) for i in range(30)}
    texts |= {i: " ".join(r.choice(("zxq", "wvk", "jjq")) + str(r.randrange(60)) for _ in range(90)) for i in range(30, 45)}
    texts |= {45: None, 46: "", 47: prose(1, 70_000), 48: prose(3, 60), 49: "one"}
    labels = [(i, 1 if i < 20 else 0, 0) for i in range(40)] + [(20, 1, 0), (0, None, 0), (None, 1, 0), (99, 1, 0), (5, 1, 0)]
    docs = [(i, t, 777, "mine", t) for i, t in texts.items()] + [(48, texts[48], 777, "mine", "again")]
    return texts, spark.createDataFrame(docs, "doc_id long, text string, score int, n_words string, kept string"), labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def bucket_of(spark, texts):
    """The bucket of each n-gram, by the same hash."""
    known = sorted({g for t in texts.values() for g in grams(t)})
    df = spark.createDataFrame([(i, *g, *[None] * (2 - len(g))) for i, g in enumerate(known)], "i int, a string, b string")
    one, two = F.xxhash64("a"), F.xxhash64("a", "b")
    found = df.select("i", F.pmod(F.when(F.col("b").isNull(), one).otherwise(two), F.lit(quality.BUCKETS)).alias("k")).collect()
    return {known[r.i]: r.k for r in found}


def test_scores_against_counts(spark, corpus):
    texts, docs, labels, frame = corpus
    own = {}
    for i, q, _ in labels:
        own.setdefault(i, []).append(q)
    # a label without a value does not count, as an id without one
    trusted = {i for i, qs in own.items() if i is not None and min(q for q in qs if q is not None) == 1}
    bucket = bucket_of(spark, texts)
    raw, good = Counter(), Counter()
    for i, t in [*texts.items(), (48, texts[48])]:
        for g in grams(t):
            raw[bucket[g]] += 1
            good[bucket[g]] += i in trusted
    share = sum(good.values()) / sum(raw.values())
    weight = lambda k: math.log((good[k] + quality.PRIOR * share) / ((raw[k] + quality.PRIOR) * share))
    got = rows(quality.judge_documents(docs, frame))
    assert quality.judge_documents(docs, frame).count() == len(texts) + 1
    for i, t in texts.items():
        gs = grams(t)
        if not gs:
            assert got[i].score is None and got[i].base_failed and not got[i].kept
            continue
        score = sum(weight(bucket[g]) for g in gs) / len(gs)
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].n_words == len(words(t))
        assert got[i].kept == (not got[i].base_failed and score >= quality.THRESHOLD)
    assert not got[30].kept and got[0].kept


def test_columns_and_rows_stay(spark, corpus):
    texts, docs, _, labels = corpus
    out = quality.keep_good(docs, labels)
    assert out.schema == docs.schema
    kept = out.collect()
    assert {r.score for r in kept} == {777} and {r.n_words for r in kept} == {"mine"}
    assert sum(r.doc_id == 48 for r in kept) == 2
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.judge_documents(docs, labels.limit(0)).where(f"score IS NOT NULL").count() == 0
