"""The language model against definitions: counts, one token after another, gradients by differences."""

import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, prose, rows
from tidewright.llm import lm


def words_of(text):
    return (text or "").encode().lower().split() + [b""]


def log_softmax(x):
    top = max(x)
    return [v - top - math.log(sum(math.exp(u - top) for u in x)) for v in x]


def class_logs(attention, context, at):
    """Log probabilities of all classes behind the inputs context, whose last one stands at place `at` of the text."""
    w = {k: v.astype(float) for k, v in attention.w.items()}
    first = max(0, at // lm.STEP * lm.STEP - (lm.WINDOW - lm.STEP))
    seen, own = context[first:], context[-1]
    hidden = list(w["own"][own])
    for h in range(lm.HEADS):
        weights = [math.exp(w["query"][h, own] @ w["key"][h, c] + w["place"][h, len(seen) - 1 - j]) for j, c in enumerate(seen)]
        for d in range(lm.PART):
            hidden[h * lm.PART + d] += sum(p * w["value"][h, c, d] for p, c in zip(weights, seen)) / sum(weights)
    hidden = np.array([x / (1 + abs(x)) for x in hidden] + [1.0])
    groups = log_softmax(list(hidden @ w["group"]))
    return [groups[g] + x for g in range(lm.GROUPS) for x in log_softmax(list(hidden @ w["member"][g]))]


def brute_score(text, subwords, classes, attention, counts, total):
    """log10 probability of a text, one token after another."""
    out, context, at = 0.0, [lm.BEGIN], 0
    starts, logs = [], []
    for word in words_of(text):
        ids = [subwords.end] if word == b"" else list(subwords.cut([word])[0])
        starts.append(len(logs))
        for i in ids:
            now = class_logs(attention, context, at)
            begin = math.log(sum(math.exp(x) for x in now[: lm.BEGIN_GROUPS * lm.GROUP]))
            logs.append((now[classes.of[i]] + classes.within[i], begin))
            context.append(classes.of[i])
            at += 1
    for k, (word, a) in enumerate(zip(words_of(text), starts)):
        b = starts[k + 1] if k + 1 < len(starts) else len(logs)
        spelled = sum(x for x, _ in logs[a:b]) - (logs[a][1] if a else 0.0) + (logs[b][1] if b < len(logs) else 0.0)
        out += math.log10(0.5 * math.exp(spelled) + 0.5 * counts[word] / total)
    return out


def fitted(docs, subwords, words):
    """The classes and the attention that the training documents give."""
    cut = lm.cut_texts(docs, subwords)
    counts = cut.where("n > 0").groupBy("word").agg({"n": "sum"}).toDF("word", "n")
    classes = lm.Classes.from_counts(lm.count_subwords(counts, subwords), np.append(subwords.begins, True))
    return classes, lm.train(cut.where("row is not null"), classes, words)


def test_scores_against_one_token_after_another(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)  # most words are joined, not broadcast
    texts = {i: prose(i, 30) for i in range(60)} | {60: None, 61: "", 62: "Lower UPPER ünï " + prose(1, 9), 63: "a" * 300, 64: "\x0b \n", 65: prose(3, 30)}
    df = spark.createDataFrame(list(texts.items()), DOCS)
    got = rows(lm.score_documents(df))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in words_of(texts[i]))
    n, v = sum(counts.values()), len(counts)
    subwords = lm.Subwords.load()
    classes, attention = fitted(df.where(~lm.is_held_out(df.doc_id)).select(df.doc_id.alias("key"), "text"), subwords, n)
    assert sorted(got) == sorted(texts)
    for i, text in texts.items():
        own = words_of(text)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert got[i].score == pytest.approx(brute_score(text, subwords, classes, attention, counts, n), rel=2e-4)


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, prose(1, 20)), (None, prose(1, 20)), (3, prose(2, 20)), (3, prose(2, 20))], DOCS)
    got = [r.asDict() for r in lm.score_documents(df).collect()]
    assert len(got) == 4 and sum(r["doc_id"] is None for r in got) == 2
    assert len({r["score"] for r in got}) == 2
    assert lm.score_documents(df.limit(0)).count() == 0
    none_known = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")], DOCS)
    assert rows(lm.score_documents(none_known)).popitem()[1].train_tokens == 0


def test_the_model_follows_from_all_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(lm, "FOLD_WORDS", 40)  # several folds in a round
    monkeypatch.setattr(lm, "HELD_OUT", -1)
    texts = [(i, prose(i, 30)) for i in range(24)]
    subwords = lm.Subwords.load()
    frame = lambda data, parts=1: spark.createDataFrame(data, "key long, text string").repartition(parts)
    classes, whole = fitted(frame(texts), subwords, 720)
    fit = lambda data, parts=1: lm.train(lm.cut_texts(frame(data, parts), subwords).where("row is not null"), classes, 720).flat.tobytes()
    assert fit(texts[::-1], 5) == whole.flat.tobytes()  # whatever the layout
    assert all(fit([*texts[:i], (i, prose(99, 30)), *texts[i + 1 :]]) != whole.flat.tobytes() for i in (0, 23))


def test_attention_learns():
    r = random.Random(1)
    pattern = lambda: np.array([5 + 7 * ((i + j) % 3) for i in [r.randrange(3)] for j in range(40)], np.uint8)
    row, starts, goal, _ = lm.inputs_and_starts([pattern() for _ in range(3000)])
    x = row[starts[:, None] + np.arange(lm.WINDOW)]
    model = lm.Attention.initial(np.full(lm.CLASSES, -math.log(lm.CLASSES)))
    moments = None
    for _ in range(8):
        moments = model.train(x, goal, 0.02, moments)
    first = goal != lm.PAD
    logs = lm.Attention(model.flat).score(x, goal)[0].reshape(goal.shape)[first]
    assert logs.mean() > -0.15  # the first of 40 is one of three; the rest follow


def test_attention_gradient_and_single_scoring():
    r = np.random.default_rng(2)
    ids = [r.integers(0, lm.CLASSES, k).astype(np.uint8) for k in (1, 5, 16, 17, 70)]
    row, starts, goal, text = lm.inputs_and_starts(ids)
    x = row[starts[:, None] + np.arange(lm.WINDOW)]
    for k, own in enumerate(ids):  # each subword is a goal once, in order
        assert [g for g in goal[text == k].reshape(-1) if g != lm.PAD] == list(own)
    model = lm.Attention(lm.Attention.initial(np.zeros(lm.CLASSES)).flat.astype(np.float64))
    loss = lambda: -lm.Attention(model.flat).score(x, goal)[0].sum() / (goal != lm.PAD).sum()
    slope = lm._named(model.gradient(x, goal))
    for name, g in slope.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, values = model.w[name][at], []
        for step in (1e-4, -1e-4):
            model.w[name][at] = old + step
            values.append(loss())
        model.w[name][at] = old
        assert (values[0] - values[1]) / 2e-4 == pytest.approx(g[at], rel=1e-3, abs=1e-8)


def test_probabilities_sum_to_one():
    classes = lm.Classes.from_counts(np.arange(1000.0), np.arange(1000) % 3 == 0)
    model = lm.Attention.initial(classes.share)
    x = np.full((lm.CLASSES, lm.WINDOW), lm.PAD, np.uint8)
    x[:, lm.WINDOW - lm.STEP] = lm.BEGIN
    goal = np.full((lm.CLASSES, lm.STEP), lm.PAD, np.uint8)
    goal[:, 0] = np.arange(lm.CLASSES)
    logs = model.score(x, goal)[0].reshape(goal.shape)[:, 0]
    assert np.exp(logs).sum() == pytest.approx(1.0, rel=1e-4)
    assert np.bincount(classes.of, np.exp(classes.within)).sum() == pytest.approx(len(set(classes.of.tolist())), rel=1e-6)


def test_sums_by_class():
    r = np.random.default_rng(3)
    ids, rows = r.integers(0, 40, (6, 5)).astype(np.uint8), r.standard_normal((30, 3))
    wanted = np.zeros((lm.SYMBOLS, 3))
    np.add.at(wanted, ids.ravel(), rows)
    assert np.allclose(lm._summed(ids, rows), wanted)
    assert not lm._summed(ids[:0], rows[:0]).any()


@pytest.mark.skipif(not hasattr(os, "confstr") or not (os.confstr("CS_GNU_LIBC_VERSION") or "").startswith("glibc"), reason="memory is kept by glibc")
def test_a_step_of_training_takes_no_new_pages():
    code = """
import resource
import numpy as np
from tidewright.llm import lm
lm.keep_freed()
r = np.random.default_rng(1)
x, goal = r.integers(0, lm.CLASSES, (lm.BATCH, lm.WINDOW)).astype(np.uint8), r.integers(0, lm.CLASSES, (lm.BATCH, lm.STEP)).astype(np.uint8)
own = lm.Attention.initial(np.log(np.full(lm.CLASSES, 1 / lm.CLASSES)))
moments = own.train(x, goal, 0.01)
moments = own.train(x, goal, 0.01, moments)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
own.train(x, goal, 0.01, moments)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(lm.__file__) + "/../..")
    assert int(found.stdout) < 500  # thousands where each step's arrays are given back to the system
