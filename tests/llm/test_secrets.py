"""The lexer against sources whose values are put together whole."""

import math
import random
import time
from collections import Counter

import pytest

from tests.llm.test_operators import DOCS, rows
from tidewright.llm import secrets

NAMES = ["db_password", "clientSecret", "cfg.api_key", "plain", "colour", "service.auth.token", "base", "a.b.part", "privateKeyText", "n1"]
LITERALS = ["q8ZxLm71", "hunter2hunter2", "/usr/lib/x86", "some words here", "changeme123", "Zz9", "http://x.y/z1a2b3c4", "xx", "xxx1A", "none", "aB3dE5gH7jK9mN1p"]


def whole_score(value):
    """The score of a value by its whole text."""
    if len(value) < 6 or secrets._STANDS_IN.search(value) or value.startswith("<") or secrets._NOTHING.fullmatch(value):
        return -1.0
    n, counts = len(value), Counter(value)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    out = 0.1 + 0.1 * (n >= 12) + (0.2 if bits > 3 else 0.1 if bits > 2.5 else 0)
    out += 0.15 * (any(map(str.isdigit, value)) and any(map(str.isalpha, value))) - 0.4 * any(map(str.isspace, value))
    return out - 0.3 * ("://" in value or value.startswith("/"))


@pytest.mark.parametrize("seed", range(60))
def test_assignments_against_whole_values(seed):
    r = random.Random(seed)
    names = r.sample(NAMES, r.randint(2, 8))
    order = names[:]  # a name may use those before it in `names`, wherever they stand in the text
    r.shuffle(order)
    parts, text = {}, ""
    for name in order:
        before = names[: names.index(name)]
        parts[name] = []
        text += r.choice(("", "const ", "export ", "x; ", "\t")) + name + r.choice((" = ", "=", ": ", ': str = ', "\t\t\t:= "))
        for k in range(r.randint(1, 3)):
            text += " + " if k else ""
            if before and r.random() < 0.5:
                used = r.choice(before)
                parts[name].append(("use", used, None, None))
                text += used if r.random() < 0.5 else used.rpartition(".")[2]
            else:
                literal = r.choice(LITERALS)
                parts[name].append(("text", literal, len(text) + 1, len(text) + 1 + len(literal)))
                text += f'"{literal}"'
        text += r.choice(("\n", ";\n", "\n\n"))

    def value(name):
        return "".join(x if kind == "text" else value(x) for kind, x, _, _ in parts[name])

    def first(name):
        kind, x, a, b = parts[name][0]
        return (a, b) if kind == "text" else first(x)

    want = {}
    for name in order:
        score = secrets.name_weight(name) and secrets.name_weight(name) + whole_score(value(name))
        if score >= secrets.THRESHOLD:
            for kind, x, a, b in parts[name]:
                kinds = "propagated" if any(k == "use" for k, *_ in parts[name]) else "lexed"
                want.setdefault((a, b) if kind == "text" else first(x), set()).add((kinds, round(score, 4)))
    got = {}
    for kind, a, b, score in secrets.lex(text):
        got.setdefault((a, b), set()).add((kind, score))
    assert got == want, text


def lexed(text):
    return [(k, text[a:b]) for k, a, b, _ in secrets.lex(text)]


def test_names_and_values_without_bounds():
    secret = "q8ZxLm71aB3d"
    assert lexed("passphrase_" + "a" * 5000 + f' = "{secret}"') == [("lexed", secret)]
    assert lexed(f'passphrase{" " * 5000}= "{secret}"') == [("lexed", secret)]
    for n in (10, 4000, 4200, 90_000):
        long = "aB3dE5gH" * (n // 8)
        assert lexed(f'passphrase = "{long}"') == [("lexed", long)]
        assert lexed(f'passphrase = "{long}changeme"') == []
        assert lexed("passphrase = k" + long) == [("lexed", "k" + long)]
    doubled = 'a0 = "aB3dE5gH"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, 200)) + "client_passphrase = a199\n"
    assert lexed(doubled) == [("propagated", "aB3dE5gH")]
    assert lexed('a = b\nb = a\npassphrase = a + "q8ZxLm71aB3d"\n')[-1] == ("propagated", "q8ZxLm71aB3d")


def test_dotted_and_later_constants():
    assert ("propagated", "q8ZxLm71") in lexed('cfg.base = "q8ZxLm71"\nclient_passphrase = cfg.base\n')
    assert ("propagated", "q8ZxLm71") in lexed('client_passphrase = cfg.base\ncfg.base = "q8ZxLm71"\n')
    assert lexed('self.one = "q8ZxLm71"\nother.one = "zzzz"\nclient_passphrase = self.one') == [("propagated", "q8ZxLm71")]
    assert lexed('x = "q8ZxLm71"\nx = "Rr7Tt8Yy"\nclient_passphrase = x') == [("propagated", "Rr7Tt8Yy")]
    assert lexed('part = "q8Zx"\npassphrase = "${part}Lm71pW"')[0][0] == "propagated"


def test_edges_and_redaction(spark):
    text = 'passphrase = "q8ZxLm71aB3d"\n'
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "t"), (None, text, "u"), (2, None, "v"), (3, "", "w"), (4, "x = 1\n" * 40_000 + text, "x")], "doc_id long, text string, spans string")
    out = secrets.find_secrets(docs)
    assert out.columns == ["doc_id", "spans", "redacted"] and out.count() == 6
    got = sorted((str(r.doc_id), len(r.spans), (r.redacted or "")[-24:]) for r in out.collect())
    assert got == sorted([*[(i, 1, f'passphrase = "{secrets.REDACTED}"\n'[-24:]) for i in ("1", "1", "None", "4")], ("2", 0, ""), ("3", 0, "")])
    assert rows(out.where("doc_id = 2"))[2].redacted is None
    assert secrets.secret_digests(docs.limit(0)).count() == 0
    assert rows(secrets.secret_digests(spark.createDataFrame([(1, "token=abcdef token=abcdef")], DOCS)))[1].n_assign == 2


def base_by_hand(text):
    """Base spans by walking the text, without regular expressions."""
    word, value = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "+/_.=-"
    out = []

    def run(at, letters):
        while at < len(text) and text[at] in letters:
            at += 1
        return at

    def assign(at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c in word else c for c in text[at : at + len(name)]) != name:
                continue
            for skip in (1, 0):  # the quote may be left out, so it may also be none
                k = at + len(name)
                if skip:
                    if text[k : k + 1] not in ("'", '"'):
                        continue
                    k += 1
                k = run(k, " ")
                if text[k : k + 1] not in (":", "="):
                    continue
                k = run(k + 1, " ")
                k += text[k : k + 1] in ("'", '"')
                if (end := run(k, word + value)) > k:
                    return k, end
        return None

    at = 0
    while at < len(text):
        if found := assign(at):
            if found[1] - found[0] >= 6:
                out.append(("assign", at, found[1]))
            at = found[1]
        else:
            at += 1
    for kind, head, letters, least in (("access", "AKIA", word[:36], 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), letters) if text.startswith(head, at) else at
            if end > at + len(head):
                out += [(kind, at, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@pytest.mark.parametrize("seed", range(5))
def test_base_spans_of_random_texts_against_a_walk(seed):
    r = random.Random(seed)
    pieces = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "api-key", "=", ":", " ", "  ", '"', "'", "abc", "hunter2/x", "é", "ſecret", "\n", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOPQ", "0123456789ab", "deadbeefdead", "K", "_", "=="]
    for _ in range(2_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert [x[:3] for x in secrets.scan(text) if x[0] in secrets.BASE_KINDS] == base_by_hand(text), text


@pytest.mark.parametrize("unit", ["k=v&", "a=b+", "a:", "token=b+", "token=a1&", "passphrase='a'+", "a=b+'", "secret=$secret ", "x = ${x}${x} "])
def test_runs_of_assignments_take_time_in_proportion(unit):
    took = []
    for n in (50_000, 400_000):
        began = time.process_time()
        secrets.redact(text := unit * (n // len(unit)), secrets.scan(text))
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1  # 8 times the text


def test_values_of_one_run_are_scored_as_whole_texts():
    r = random.Random(8)
    for _ in range(300):
        run = "".join(r.choice(["k", "=", ":", "a1", "Zz9aB3", "xxxx", "&", "/", "q8", "-", "changeme"]) for _ in range(r.randint(1, 15)))
        tail = r.choice(["", "", ' + "q8ZxLm71"', ' + "xx" + "B4"'])
        added = "".join(tail.split('"')[1::2])
        literals, sums = secrets._assignments(text := "plain=" + run + tail)[1], {}
        every = [x for x in literals.at.values() if x]
        for one in every:
            if one.behind:
                one.behind.is_used = True
        by_end = {}
        for one in every:
            if not one.quoted:
                by_end.setdefault(one.end, []).append(one)
        for one in every:
            secrets._evaluate(text, one, by_end)
            sums[one.start] = one.known[0]
            if not one.quoted:
                assert abs(one.known[0].score() - whole_score(text[one.start : one.end] + added)) < 1e-9, (text, one)
