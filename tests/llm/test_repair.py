import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tidewright.llm import repair

TURNS = "conv_id long, turn long, role string, text string, rows string, signature string"
ALLOWED = re.compile(r"(s?(ua)+)?")


def cheapest(rows, marks):
    """Cost, edits and rows of the least edits by trying all with up to two rows put in at each place."""
    best = None
    n = len(rows)
    for choice in product("KRD", repeat=n):
        if any(m in ("blank", "duplicate") and c != "D" for c, m in zip(choice, marks)):
            continue
        for puts in product(range(3), repeat=n + 1):
            audit = "".join("I" * p + c for p, c in zip(puts, (*choice, "")))
            cost = 2 * audit.count("I") + 2 * audit.count("R") + 3 * audit.count("D") + sum(m == "truncated" and c != "D" for c, m in zip(choice, marks))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            slots = [x for x in audit if x != "D"]
            # roles of R and I are free: they must fill the places that kept rows leave
            for system in (False, True):
                want = ("s" if system else "") + "ua" * len(slots)
                want = want[: len(slots)]
                if not ALLOWED.fullmatch(want) or (system and (not slots or slots[0] != "K")):
                    continue
                out, at, k, good = [], 0, 0, True
                for x in audit:
                    if x == "D":
                        at += 1
                        continue
                    role = {"u": "user", "a": "assistant", "s": "system"}[want[k]]
                    if x == "K":
                        good &= rows[at][0][:1] == want[k]
                        out.append(rows[at])
                    else:
                        out.append((role, "" if x == "I" else rows[at][1]))
                    at += x != "I"
                    k += 1
                if good:
                    best = (cost, audit, out)
    return best


def damage(turns):
    out = []
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        row = (turn, "user" if kind == 4 else shown(role), "" if kind == 1 else re.sub("[.!?]", "", shown(text)) if kind == 2 else shown(text))
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def expected(turns):
    rows = damage(turns)
    marks, seen = [], []
    for _, role, text in rows:
        rest = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        marks.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.append((role, text))
    t = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    cost, audit, out = cheapest([r[1:] for r in rows], marks)
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (max(t) - min(t) + 1 - len(t) if t else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some_turns():
    r = random.Random(2)
    out = [(None, 0, "user", "Yes."), (None, None, "assistant", None), (None, None, None, "x!"), (1, None, "user", "hm."), (1, None, "user", "hm."), (2, 5, "", "Empty role."), (2, 5, "tool", "Tied."), (2, 9, "system", "S.")]
    for conv in range(3, 90):
        for turn in range(r.randint(1, 4)):
            out.append((conv, turn + (r.random() < 0.1), r.choice(["user", "assistant", "system", "user", "assistant", "tool"]), r.choice(["Good.", "Well! ", "cut off", " \t", "Fine.\n", None, "a.b"])))
    return out


def test_conversations_are_repaired_as_by_trying_all_edits(spark):
    turns = some_turns()
    df = spark.createDataFrame([(*t, "r", "s") for t in turns], TURNS).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(df).collect()}
    own = {}
    for t in turns:
        own.setdefault(t[0], []).append(t)
    assert got == {c: expected(ts) for c, ts in own.items()}
    assert repair.repair_digests(df.limit(0)).count() == 0


def test_signatures_walk_the_trie_once(monkeypatch):
    words = sorted({"".join(w) for k in range(5) for w in product("suaoxUA", repeat=k)})
    calls = []
    plain = repair.advance
    monkeypatch.setattr(repair, "advance", lambda layer, mark: calls.append(mark) or plain(layer, mark))
    found = list(repair.walk(iter(words)))
    assert len(calls) == len(words) - 1  # every node of the trie but the root, once
    r = random.Random(3)
    for signature, cost, audit in r.sample(found, 60):
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        rows = [(roles.get(c.lower(), "user"), str(i)) for i, c in enumerate(signature)]
        marks = ["blank" if c == "x" else "truncated" if c.isupper() else None for c in signature]
        want = cheapest(rows, marks)
        assert (cost, audit, repair.repaired(rows, audit)) == want


def test_repaired_rows_follow_each_other(spark):
    df = spark.createDataFrame([(*t, "r", "s") for t in some_turns()], TURNS)
    for row in repair.repair(repair.damaged(df)).collect():
        assert ALLOWED.fullmatch("".join(x.role[:1] for x in row.rows))


@pytest.mark.parametrize("n", [20_000])
def test_a_very_long_conversation(n):
    rows = [("user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(n)]
    rows[n // 2] = ("assistant", "Out of turn.")
    *_, signature = repair.facts([(i, *r) for i, r in enumerate(rows)])
    [(_, cost, audit)] = repair.walk(iter([signature]))
    assert cost == 2 and len(audit) == n and audit.count("R") == 1
