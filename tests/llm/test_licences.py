import os
import re
import textwrap

import pytest

from tests.llm.test_operators import DOCS, rows
from tidewright.llm import licences

FOLDER = "/usr/share/common-licenses"


def found(spark, texts, known=None):
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    return {i: r.license_id for i, r in rows(licences.find_licences(docs, licences.known_digests(spark, known))).items()}


def test_whole_wrapped_and_recased_licences(spark):
    texts, want = {}, {}
    for n, (name, title, body) in enumerate(licences.TEXTS):
        long = len(body) > 100
        variants = [body, body.upper(), f"{title}\n\n{body}", f"/* Copyright (c) 2020-2024 Some One\n   All rights reserved. */\n{body}", f"© Some One\n{body}"]
        for width in (30, 41, 52, 63, 70, 79, 96) if long else ():  # any word may begin a line, copyright too
            variants.append("\n".join(" * " + x for p in body.split("\n") for x in (textwrap.wrap(p, width) or [""])))
        variants += [re.sub(r"\b((?:sub)?licen)s", r"\1c", body, flags=re.IGNORECASE), body + " and more", body[len(body) // 2 :]]
        for k, v in enumerate(variants):
            texts[100 * n + k] = v
            want[100 * n + k] = name if k < len(variants) - 2 else None
    assert found(spark, texts) == want


def test_copyright_lines_and_words(spark):
    canon = lambda t: spark.createDataFrame([(t,)], "t string").select(licences.canonical(licences.F.col("t"))).first()[0]
    assert canon("Copyright 1999 A\n(c) B\nCopyright [yyyy] [name]\nAll rights reserved.\nCopyright notice and this\ncopyright holders be liable") == "copyright notice and this copyright holders be liable"
    assert canon("upper century, per cent") == "upper century percent"
    assert canon("The Licence, licences; relicence https://x") == "the license licenses relicence http x"


def test_edges(spark):
    body = licences.TEXTS[0][2]
    assert found(spark, {1: None, 2: "", 3: "?!", 4: "word " * 300_000, 5: body}) == {1: None, 2: None, 3: None, 4: None, 5: licences.TEXTS[0][0]}
    docs = spark.createDataFrame([(None, body, "x"), (None, body, "y"), (7, body, "z")], "doc_id long, text string, license_id string")
    out = licences.find_licences(docs, licences.known_digests(spark))
    assert out.columns == ["doc_id", "n_canonical", "digest", "license_id"]
    assert [r.license_id for r in out.collect()] == [licences.TEXTS[0][0]] * 3
    assert licences.find_licences(docs.limit(0), licences.known_digests(spark)).count() == 0
    assert licences.find_licences(docs, licences.known_digests(spark).limit(0)).where("license_id is not null").count() == 0
    more = spark.createDataFrame([("AA", body), ("own", "my own words")], "license_id string, text string")
    assert found(spark, {1: body, 2: "My own  WORDS!"}, more) == {1: "AA", 2: "own"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts on this machine")
def test_digests_of_long_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    here = {f: open(f"{FOLDER}/{f}", encoding="utf-8").read() for f in names if os.path.exists(f"{FOLDER}/{f}")}
    texts = {i: t for i, t in enumerate(here.values())} | {100 + i: " ".join(t.split()).swapcase() for i, t in enumerate(here.values()) if "opyright" not in t[:200]}
    got = found(spark, texts)
    assert [got[i] for i in range(len(here))] == [names[f] for f in here]
