"""The pipeline against its stages done one document after another in plain Python."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import prose, rows
from tests.llm.test_quality import bucket_of, grams, words
from tidewright.llm import near_dup, pieces, quality, secrets

SCHEMA = "doc_id long, text string, lang string, score int, __n string, n_chars int"


def passes(texts, trusted, bucket):
    """The ids that the quality rules keep."""
    raw, good = Counter(), Counter()
    for i, t in texts:
        for g in grams(t):
            raw[bucket[g]] += 1
            good[bucket[g]] += i in trusted
    share = sum(good.values()) / sum(raw.values())
    out = []
    for k, (_, t) in enumerate(texts):
        own, w = grams(t), words(t)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = Counter(windows)
        repeated = {j + d for j, x in enumerate(windows) if many[x] > 1 for d in range(3)}
        if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
            continue
        score = sum(math.log((good[bucket[g]] + quality.PRIOR * share) / ((raw[bucket[g]] + quality.PRIOR) * share)) for g in own) / len(own)
        if score >= quality.THRESHOLD:
            out.append(k)
    return out


def plain_words(t):
    return re.sub(r"[\W_]+", " ", t.lower()).split()


def shingled(t):
    w = plain_words(t)
    return Counter(tuple(w[j : j + near_dup.SHINGLE]) for j in range(max(1, len(w) - near_dup.SHINGLE + 1)))


def one_of_each(texts, kept):
    """Of the kept rows the first of each class of similar texts."""
    bags, of = {k: shingled(texts[k][1]) for k in kept}, {k: k for k in kept}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a in kept:
        for b in kept:
            both = sum((bags[a] & bags[b]).values())
            if a < b and both >= near_dup.SIMILARITY * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                of[root(b)] = root(a)
    best = {}
    for k in kept:
        key = (texts[k][0] is None, texts[k][0] or 0)
        if root(k) not in best or key < best[root(k)][0]:
            best[root(k)] = (key, k)
    return sorted(k for _, k in best.values())


def leaked(t, item):
    h, x = plain_words(t), plain_words(item)
    return any(sum(0 <= j + s < len(h) and h[j + s] == w for j, w in enumerate(x)) >= 0.5 * len(x) for s in range(-len(x), len(h)))


def test_run_against_plain_python(spark, tmp_path):
    r = random.Random(5)
    item, other = prose(900, 25), prose(901, 18)
    texts = [(i, prose(i, r.randint(60, 110))) for i in range(24)]
    for i in range(24, 36):  # copies, near copies, and some that are not near enough
        w = texts[r.randrange(24)][1].split()
        for _ in range(r.choice((0, 0, 1, 2, 9))):
            w[r.randrange(len(w))] = prose(r.randrange(10**6), 1)
        texts.append((i, " ".join(w)))
    texts += [(40, prose(40, 40) + " " + item + " " + prose(41, 40)), (41, prose(42, 60) + " " + other), (None, prose(43, 70)), (None, prose(44, 70)), (42, prose(45, 60)), (42, prose(46, 60)), (42, prose(46, 60))]
    texts += [(50, prose(47, 60) + ' client_secret = "q8ZxLm71aB3d"'), (51, prose(48, 60) + ' db = "hunter2hunter2"\npassword = db'), (52, None), (53, ""), (54, "short"), (55, "a b c " * 40)]
    texts += [(i, " ".join(r.choice(("zxq", "wvk")) + str(r.randrange(50)) for _ in range(80))) for i in range(60, 68)]
    labels = [(i, 1 if i < 60 else 0, 0) for i in range(70)]
    spark.createDataFrame([(i, t, "en", 7, "x", len(t or "")) for i, t in texts], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, other), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = passes(texts, {i for i, q, _ in labels if q}, bucket_of(spark, dict(enumerate(t for _, t in texts))))
    chosen = [k for k in one_of_each(texts, good) if not any(leaked(texts[k][1], x) for x in (item, other))]
    model, want = pieces.Model.load(), []
    for k in chosen:
        i, t = texts[k]
        text = secrets.redact(t, secrets.scan(t))
        want.append((i, text, "en", 7, "x", len(text), model.encode(text), len(model.encode(text)) // 2))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "pieces", "n_pieces"]
    plain = lambda x: str((*x[:6], bytes(x[6]), x[7]))
    assert sorted(map(plain, out.collect())) == sorted(map(plain, want))
    assert len(good) > 30 and len(want) < len(good)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == {}
