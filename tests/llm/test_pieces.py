"""The split of the greatest sum of scores against all splits."""

import random

import pytest

from tests.llm.test_operators import prose, rows
from tidewright.llm import pieces


def splits(model, unit):
    """(score, pieces) of every split of unit; a character that is no piece may stand alone."""
    if not unit:
        yield 0.0, ()
        return
    table = {p[0]: (p[1], i) for i, p in enumerate(model.pieces) if p and p[0]}
    for k in range(1, len(unit) + 1):
        head = unit[:k]
        if head in table:
            score, own = table[head][0], (table[head][1],)
        elif k == 1:
            score, own = model.unknown_score, tuple(model.byte_ids[b] for b in head.encode())
        else:
            continue
        for rest, ids in splits(model, unit[k:]):
            yield score + rest, own + ids


def test_small_models_against_all_splits():
    for seed in range(150):
        r = random.Random(seed)
        texts = {"".join(r.choice("ab▁é") for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 12))}
        model = pieces.Model([(t, r.choice((-1.0, -2.0, -2.5, -4.0, -7.0))) for t in sorted(texts)] + [None] * 256, range(len(texts), len(texts) + 256))
        unit = "".join(r.choice("ab▁éc") for _ in range(r.randint(1, 9)))
        found = tuple(model.best(unit))
        every = list(splits(model, unit))
        top = max(score for score, _ in every)
        assert any(ids == found and score == pytest.approx(top) for score, ids in every), (seed, unit)


def test_the_public_model_against_all_splits():
    model = pieces.Model.load()
    for seed in range(40):
        unit = "▁" + random.Random(seed).choice(prose(seed, 9).split())[:9]
        every = list(splits(model, unit))
        top = max(score for score, _ in every)
        assert tuple(model.best(unit)) in {ids for score, ids in every if score == pytest.approx(top)}


def test_units_make_no_difference():
    model = pieces.Model.load()
    for text in (prose(4, 30), "  two  spaces ", "▁▁ marks ▁", "naïve 😀 \t\n x", "a" * 500):
        whole = pieces.Model(model.pieces, model.byte_ids)
        whole.__dict__["units"] = None  # no cut into words
        assert model.decode(model.encode(text)) == whole.decode(whole.encode(text)) == text
        assert len(model.encode(text)) == len(whole.encode(text))


def test_edges(spark):
    texts = [(1, "x y"), (1, "x y"), (None, None), (2, ""), (3, prose(1, 60_000)), (4, "\x00▁ �")]
    docs = spark.createDataFrame([(*t, "mine", 5) for t in texts], "doc_id long, text string, pieces string, n_pieces int")
    out = pieces.encode_documents(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == 6
    got = pieces.encoded_digests(docs)
    assert got.count() == 6 and got.where("not round_trip").count() == 0
    assert rows(got)[2].n_pieces == 0 and rows(got)[None].n_pieces == 0 and rows(got)[3].n_chars == len(texts[4][1])
    assert pieces.encoded_digests(docs.limit(0)).count() == pieces.encode_documents(docs.limit(0)).count() == 0
    codec = pieces.Codec(spark)
    back = docs.select("doc_id", "text", codec.decode(codec.encode(docs.text)).alias("back"))
    assert all(r.text == r.back for r in back.collect())
