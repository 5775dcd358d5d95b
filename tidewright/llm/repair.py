"""Repair of the turn structure of conversations by a dynamic program over a prefix trie.

A conversation is damaged, its rows are put in order and each becomes one character: its role's initial and its first
fault. Only these signatures decide the cheapest repair, so they are made distinct, dealt out by ranges and sorted:
sorted signatures are a walk through their prefix trie, on which a stack holds the layers of the program of the current
prefix. A layer is computed once for each node that a range visits, and a signature's answer is read off at its terminal node.

The program: behind each row there are four states, by the last role given: nothing yet, system, user, assistant. For each
the cheapest edits count, and of equally cheap ones those that read least as a string. All edit strings of a layer hold the
same number of Keep, Rerole and Delete and end in one of them, so none is the beginning of another; thus a string's rank in
its layer decides every comparison of longer ones, and layers hold ranks and steps back instead of strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import Tables, bounded, crc32_sql

#: Costs of the edits; a truncated row that is not deleted adds one.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States, by the last role given.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a user or assistant row leads to.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Fixed value: the white space of the word contracts.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Pairs of initials that may follow each other.
LEGAL = {"su", "ua", "au"}
#: Signatures up to so many are broadcast to their conversations.
BROADCAST = 100_000

_ROWS = "array<struct<turn:long,role:string,text:string>>"
_FACTS = T.StructType([*(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")), T.StructField("signature", T.StringType())])
_REPAIRED = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


class Step(NamedTuple):
    """A state of a layer: its cost, the rank of its edits in the layer, and the step before with what was added."""

    cost: int
    rank: int
    before: int
    edits: str


Layer = dict[int, Step]
FIRST: Layer = {START: Step(0, 0, -1, "")}


def symbol(role: str, fault: str | None) -> str:
    """The character of a row: x if it must go, else its initial (o: none that may stay), upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return kind.upper() if fault == "truncated" else kind


def advance(layer: Layer, mark: str) -> Layer:
    """The layer behind a row."""
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(state: int, cost: int, rank: int, edits: str, before: int) -> None:
        if state not in found or (cost, rank, edits) < found[state][:3]:
            found[state] = (cost, rank, edits, before)

    own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(mark.lower())
    extra = TRUNCATED if mark.isupper() else 0
    for before, (cost, rank, _, _) in layer.items():
        state, edits = before, ""
        while True:
            offer(state, cost + DELETE, rank, edits + "D", before)
            if mark != "x":
                if own == _NEXT[state] or (own == SYSTEM and state == START):
                    offer(own, cost + KEEP + extra, rank, edits + "K", before)
                offer(_NEXT[state], cost + REROLE + extra, rank, edits + "R", before)
            if len(edits) == 2:  # two rows put in lead back to the same state, or on from start or system to assistant
                break
            state, cost, edits = _NEXT[state], cost + INSERT, edits + "I"
    order = sorted(found, key=lambda s: (found[s][1], found[s][2]))
    ranks = {s: k for k, s in enumerate(order)}
    return {s: Step(c, ranks[s], b, e) for s, (c, _, e, b) in found.items()}


def answer(layers: Sequence[Layer]) -> tuple[int, str]:
    """Cost and edits at the end of the path of layers: rows may still be put in, and the last must be an assistant's if there is one."""
    best = None
    for before, (cost, rank, _, _) in layers[-1].items():
        state, edits = before, ""
        while len(edits) <= 2:
            if state in (START, ASSISTANT) and (best is None or (cost, rank, edits) < best[:3]):
                best = (cost, rank, edits, before)
            state, cost, edits = _NEXT[state], cost + INSERT, edits + "I"
    cost, _, edits, state = best
    out = [edits]
    for layer in reversed(layers[1:]):
        out.append(layer[state].edits)
        state = layer[state].before
    return cost, "".join(reversed(out))


def walk(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, edits) of sorted signatures; layers of a shared beginning are computed once."""
    path, layers = "", [FIRST]
    for signature in signatures:
        shared = 0
        while shared < min(len(path), len(signature)) and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        for mark in signature[shared:]:
            layers.append(advance(layers[-1], mark))
        path = signature
        yield signature, *answer(layers)


def faults(rows: Sequence[tuple[str, str]]) -> list[str | None]:
    """The first fault of each row (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        rest = text.rstrip(SPACE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def facts(rows: Sequence[tuple[int | None, str, str]]) -> tuple:
    """The columns of _FACTS of rows (turn, role, text) in order."""
    found = faults([r[1:] for r in rows])
    turns = {int(t) for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, "".join(symbol(r[1], f) for r, f in zip(rows, found)))


def repaired(rows: Sequence[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The rows (role, text) behind the edits."""
    out, state, at = [], START, 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        if edit == "K" and state == START and rows[at][0][:1] == "s":
            state = SYSTEM
        else:
            state = _NEXT[state]
        out.append((ROLES[state], "") if edit == "I" else rows[at] if edit == "K" else (ROLES[state], rows[at][1]))
        at += edit != "I"
    return out


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id and rows (turn, role, text) of each conversation behind the damage, by turn (none first), then role, text."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_spaced("role"))
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    copies = F.when(kind == 0, F.array().cast(_ROWS)).when(kind == 3, F.array(row, row)).otherwise(F.array(row))
    return conversations.select("conv_id", copies.alias("copies")).groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("copies"))).alias("rows"))


@F.pandas_udf(_FACTS)
def _facts(rows: pd.Series) -> pd.DataFrame:
    found = [facts([(r["turn"], r["role"], r["text"]) for r in x]) for x in rows]
    return pd.DataFrame(found, columns=_FACTS.names)


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    one, out = walk(s for frame in frames for s in frame["signature"]), []
    for found in one:
        out.append(found)
        if len(out) == 1_000:
            yield pd.DataFrame(out, columns=["signature", "cost", "audit"])
            out = []
    yield pd.DataFrame(out, columns=["signature", "cost", "audit"])


def answers(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature; ranges of the sorted ones are walked apart."""
    dealt = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return dealt.mapInPandas(_walk, "signature string, cost long, audit string")


@F.pandas_udf(T.StringType())
def _digest(rows: pd.Series, audit: pd.Series) -> pd.Series:
    texts = ("\n".join(f"{r}:{t}" for r, t in repaired([(x["role"], x["text"]) for x in own], edits)) for own, edits in zip(rows, audit))
    return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in texts])


@F.pandas_udf(_REPAIRED)
def _repaired(rows: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([[{"role": r, "text": t} for r, t in repaired([(x["role"], x["text"]) for x in own], edits)] for own, edits in zip(rows, audit)])


def judged(conversations: DataFrame) -> DataFrame:
    """conv_id, rows, the faults' counts, and the cheapest edits (audit) with their cost.

    conversations: conv_id and rows (turn, role, text), ordered. A conversation is one row, however long; its signature is
    one character a turn. Signatures meet their conversations by broadcast if few, else by a join that Spark splits at common ones.
    """
    marked = Tables(conversations.sparkSession).write(conversations.select("conv_id", "rows", _facts("rows").alias("f")).select("conv_id", "rows", "f.*"))
    solved = Tables(conversations.sparkSession).write(answers(marked))
    return marked.join(F.broadcast(solved) if bounded(solved, BROADCAST) else solved, "signature").drop("signature")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, the rows (role, text) of each conversation behind the cheapest edits, and those edits as audit."""
    return judged(conversations).select("conv_id", _repaired("rows", "audit").alias("rows"), "audit")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """The faults, cheapest edits and repaired text's digest of each conversation of a table of turns, behind its damage.

    Nulls: a null conv_id is a conversation of its own; null roles, texts, turns and ids count as one space (so a null text is
    blank, and a null role has an initial that may not stay), null turns come first and are no turn of the gaps. Rows of one
    turn are ordered by role and text; repeated rows are duplicates. A role without characters has no initial and may not stay.
    A conversation without rows behind the damage has zeros, no edits and the digest of nothing; an empty table has no rows.
    Only conv_id, turn, role and text are read, so other columns may have any names.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return judged(damaged(conversations)).select("conv_id", *counts, "audit", _digest("rows", "audit").alias("repaired_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of repair_digests: the program over states as a recursive query, a row for each conversation and state."""
    moves = ", ".join(f"({s}, '{'I' * n}', {to})" for s in range(4) for n, to in enumerate((s, _NEXT[s], _NEXT[_NEXT[s]])))
    following = "CASE m.mid WHEN 2 THEN 3 ELSE 2 END"
    own, extra = "CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 END", f"CASE WHEN f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    space = r"\x20\x09-\x0D"
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS t FROM conversations),
    kinds AS MATERIALIZED (SELECT *, {crc32_sql('t')} % 20 AS k FROM src),
    rows AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE r END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text
      FROM (SELECT *, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds)),
    f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE '' END AS fault FROM
      (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM
        (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)))),
    facts AS (SELECT c.conv_id, count(f.i) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY 1),
    moves(s, ins, mid) AS (VALUES {moves}),
    walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit FROM facts UNION ALL
      SELECT conv_id, i, s, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS place FROM (
        SELECT w.conv_id, f.i, e.s, w.cost + {INSERT} * length(m.ins) + e.cost AS cost, w.audit || m.ins || e.letter AS audit
        FROM walk w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 JOIN moves m ON m.s = w.s,
          LATERAL (SELECT 'D' AS letter, m.mid AS s, {DELETE} AS cost UNION ALL SELECT 'R', {following}, {REROLE} + {extra} WHERE f.fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT 'K', {own}, {KEEP} + {extra} WHERE f.fault NOT IN ('blank', 'duplicate') AND ({own} = {following} OR ({own} = 1 AND m.mid = 0))) e)) WHERE place = 1),
    best AS MATERIALIZED (SELECT facts.*, b.cost::BIGINT AS cost, b.audit FROM facts JOIN (SELECT w.conv_id, w.i, w.cost + {INSERT} * length(m.ins) AS cost, w.audit || m.ins AS audit FROM walk w JOIN moves m ON m.s = w.s AND m.mid IN (0, 3)) b
      ON facts.conv_id IS NOT DISTINCT FROM b.conv_id AND facts.n = b.i QUALIFY row_number() OVER (PARTITION BY facts.conv_id ORDER BY b.cost, b.audit) = 1),
    letters AS (SELECT conv_id, letter, pos, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS e FROM
      (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS pos FROM best WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
    given AS (SELECT l.*, f.role, f.text, max(CASE WHEN letter = 'K' AND e = 1 AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS leads FROM letters l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i),
    texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - leads) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS t FROM given WHERE letter <> 'D' GROUP BY 1)
    SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256 FROM best b LEFT JOIN texts x ON b.conv_id IS NOT DISTINCT FROM x.conv_id"""
