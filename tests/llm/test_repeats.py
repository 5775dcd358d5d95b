import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import repeats

DOCS = "doc_id long, text string, t string, key string"


def expected(texts, window=200):
    """By definition: covered bytes of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def some_texts():
    r = random.Random(9)
    prose = lambda n: "".join(r.choice("abcdefgh éü .") for _ in range(n))
    passage, longer = prose(230), prose(700)
    texts = [None, "", "short", "short", prose(199), prose(200), "x" * 150, "x" * 199, "x" * 200, "x" * 460, "ab" * 300, longer, longer]
    for k in range(30):
        body = prose(r.randint(0, 500))
        at = r.randint(0, len(body))
        part = passage if k % 3 else longer[r.randint(0, 300) : r.randint(500, 700)]
        texts.append(body[:at] + part[: r.randint(150, 700)] + body[at:])
    edited = list(longer)
    edited[350] = "!"
    texts += ["".join(edited), longer + prose(50) + longer, passage * 3, prose(3000)]
    twice = prose(199)
    return texts + [twice + "1" + twice, twice + "2", twice + "2"]


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_documents_as_by_definition(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # with 2, the passages' buckets are cut again by longer seeds
    texts = some_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, "t", "k") for i, t in enumerate(texts)], DOCS).repartition(4)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_digests(df).collect())
    assert got == sorted((i if i % 7 else -1, *e) for i, e in enumerate(expected(texts)))


def test_tables_without_repeats(spark):
    df = spark.createDataFrame([(1, "a" * 150, "", ""), (2, None, "", "")], DOCS)
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in repeats.repeat_digests(df).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert repeats.repeat_digests(df.limit(0)).count() == 0


def test_matching_statistics_are_those_by_definition():
    r = random.Random(4)
    for letters, n in (("a", 3), ("ab", 12), ("abcd", 9), ("a", 1)):
        pieces = [bytes(r.choice(letters.encode()) for _ in range(r.randint(0, 60))) for _ in range(n)]
        index = repeats.RunIndex(pieces)
        found = index.matching_statistics()
        assert index.lengths.sum() == sum(map(len, pieces))
        places = [(k, i) for k, p in enumerate(pieces) for i in range(len(p))]
        for k, i in places:
            agree = lambda a, b: next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            want = max((agree(pieces[k][i:], pieces[m][j:]) for m, j in places if (m, j) != (k, i)), default=0)
            assert found[index.starts[k] + i] == want
    assert sum(map(len, repeats.repeated_windows([b"", b"x" * 10]))) == 0


@pytest.mark.parametrize("seed", repeats.SEEDS)
def test_pieces_hold_each_window_once_and_equal_windows_share_a_name(monkeypatch, seed):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    r = random.Random(1)
    part = bytes(r.randrange(4) for _ in range(260))
    text = part + bytes(r.randrange(256) for _ in range(900)) + part + b"z" * 700
    names, starts, counts, again = repeats.pieces_of(text, seed)
    by_window = np.repeat(names, counts)
    assert len(by_window) == len(text) - 199 and (starts == np.cumsum(counts) - counts).all()
    first = {}
    for i, name in enumerate(by_window.tolist()):
        assert first.setdefault(text[i : i + 200], name) == name
    assert again[names == by_window[-1]].all() if seed < 200 else True
    assert all(len(c) == 0 for c in repeats.pieces_of(b"x" * 199, seed))
