import hashlib
import random
import zlib

import pytest

from tidewright.llm import runs

DOCS = "doc_id long, text string, part string, start string"


def by_definition(words):
    """All runs of words, from every stretch and its smallest period."""
    n, found = len(words), []
    for i in range(n):
        for j in range(i + 6, n + 1):
            q = next(q for q in range(1, j - i + 1) if all(words[k] == words[k + q] for k in range(i, j - q)))
            if j - i < max(6, 4 * q):
                continue
            if (i and words[i - 1] == words[i - 1 + q]) or (j < n and words[j] == words[j - q]):
                continue
            found.append((i, j - i, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_definition(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


def some_texts():
    r = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "é ü " * 7, "x y z\t" * 3]
    for _ in range(40):
        letters = "ab" if r.random() < 0.5 else "abcde"
        text = [r.choice(letters) for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            root = [r.choice(letters) for _ in range(r.randint(1, 6))]
            at = r.randint(0, len(text))
            text[at:at] = (root * 8)[: r.randint(1, 8 * len(root))]
        texts.append(" ".join(text))
    return texts


def test_runs_of_many_texts_are_those_by_definition():
    texts = [(t or "").encode().split() for t in some_texts()]
    assert runs.runs_of_many(texts) == [by_definition(t) for t in texts]
    assert runs.runs_of_many([]) == []


@pytest.mark.parametrize("lags", [2_500, 3])
def test_documents_with_and_without_split_lags(spark, monkeypatch, lags):
    docs = [(i, t, "part", "s") for i, t in enumerate(some_texts())] + [(None, "b " * 9, None, None), (3, "a " * 9, "", ""), (3, "a " * 9, "", ""), (2**60 + 1, "c d " * 9, "", "")]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    scan, describe = runs._scan, runs._describe
    if lags == 3:  # a worker gets the module as it is on disk, so the bound goes with the function

        def scan(frames):
            from tidewright.llm import runs as there

            there.LAGS, there.BATCH = 3, 20
            yield from there._scan(frames)

    monkeypatch.setattr(runs, "_scan", scan)
    got = sorted((tuple(r) for r in runs.find_runs(df).collect()), key=str)
    assert got == sorted((expected(*d[:2]) for d in docs), key=str)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_a_very_long_text_of_one_word_and_one_of_a_long_period():
    text = [b"w"] * 50_000
    assert runs.runs_of_many([text[:3000]]) == [[(0, 3000, 1)]]
    root = [b"%d" % i for i in range(900)]
    assert runs.runs_of_many([[b"start", *root * 5, b"end"]]) == [[(1, 4500, 900)]]
