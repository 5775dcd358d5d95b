"""The covers inside a batch of inserts, without inserting its rows one after another.

Each difference set has the earliest operation that is known to make it: of the two rows of a proof the later one. So the sets
known at a prefix of the batch are those made before it, and their hitting sets are what is claimed to hold there. A context
that is claimed from prefix to prefix is judged once, on the last of them: a table that has more rows breaks no less. Broken claims
give proofs with the operations that made them, which move the claims to earlier prefixes, until every claim holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.cluster import Tables, at_once, with_position
from tidewright.model import Key, OrderDependency
from tidewright.operators.engine import OdEngine, of_ids
from tidewright.operators.validate import Pair, broken, touched, witnesses
from tidewright.plans.lattice import HittingSets, cover, maximal_invalid

#: Prefixes of a batch that are looked at, at most about so many.
SAMPLES = 200


@dataclass(frozen=True)
class State:
    """What holds behind the first `operations` rows of a batch."""

    operations: int
    highest_id: int | None
    ods: frozenset[OrderDependency]
    non_ods: frozenset[OrderDependency]


def prefixes(n: int, samples: int = SAMPLES) -> list[int]:
    """Every max(1, n // samples) operations, and all."""
    step = max(1, n // samples)
    return list(dict.fromkeys([*range(step, n + 1, step), n])) if n else []


class _Claims:
    """The difference sets of a key by the prefix that has them first, and the contexts claimed at each prefix."""

    def __init__(self, before: set[int], count: int):
        self.before, self.first, self.count = before, {}, count
        self._follow()

    def _follow(self) -> None:
        by_time: dict[int, list[int]] = {}
        for mask, s in self.first.items():
            by_time.setdefault(s, []).append(mask)
        now = HittingSets(self.before)
        self.contexts, self.least = [], []
        for s in range(self.count):
            for mask in by_time.get(s, ()):
                now.add(mask)
            self.contexts.append(now.sets)
            self.least.append(now.least)

    def learn(self, found: list[tuple[int, int]]) -> bool:
        """(mask, prefix): whether one is earlier than what was known."""
        news = False
        for mask, s in found:
            if mask not in self.before and s < self.first.get(mask, self.count):
                self.first[mask], news = s, True
        if news:
            self._follow()
        return news


def insert_stepwise(engine: OdEngine, delta: DataFrame, order: Column, samples: int = SAMPLES) -> list[State]:
    """Inserts delta (tid and columns) into engine and gives the states behind its prefixes in the order of a column."""
    tables, tid, columns = Tables(engine.spark), engine.tid, engine.columns
    placed = tables.write(with_position(delta, [order], "_at").select(tid, "_at", *columns))
    sizes = prefixes(placed.count(), samples)
    if not sizes:
        return []
    base = engine.rows
    claims = {k: _Claims(set(e.pairs), len(sizes)) for k, e in engine.evidence.items()}
    held: dict[OrderDependency, int] = {}  # the last prefix that a dependency was seen to hold on
    proofs: dict[tuple[Key, int], set[Pair]] = {}

    def judge(s: int, ods: set[OrderDependency]) -> tuple[set[OrderDependency], list]:
        fresh = placed.where(F.col("_at") < sizes[s]).drop("_at")
        rows = base.unionByName(fresh)
        near = touched(rows, columns, fresh)  # what is claimed held on the table before the batch
        bad = broken(rows, columns, ods, near, engine.bounds)
        return bad, witnesses(rows, columns, bad, tid, near, engine.bounds) if bad else []

    while True:
        last = {OrderDependency(k, x): s for k, c in claims.items() for s, found in enumerate(c.contexts) for x in found}
        fixed = lambda od, s: any(x & od.context == x for side in (Key(od.key.left), Key(od.key.right)) for x in claims[side].contexts[s] if held.get(OrderDependency(side, x), -1) >= s)
        open_ods = {od: s for od, s in last.items() if held.get(od, -1) < s and (od.key.constant or not fixed(od, s))}
        if not open_ods:
            break
        first = {od: s for od, s in open_ods.items() if od.key.constant} or open_ods  # constants may settle compatibles
        groups: dict[int, set[OrderDependency]] = {}
        for od, s in first.items():
            groups.setdefault(s, set()).add(od)
        found = at_once([partial(judge, s, ods) for s, ods in sorted(groups.items())])
        ids = sorted({t for _, rows in found for _, _, pairs in rows for p in pairs for t in p})
        at = {r[0]: r[1] for r in of_ids(placed, tid, ids).select(tid, "_at").collect()}
        behind = lambda pair: next(s for s, n in enumerate(sizes) if n > max(at.get(t, -1) for t in pair))
        news = False
        for (s, ods), (bad, rows) in zip(sorted(groups.items()), found):
            held |= dict.fromkeys(ods - bad, s)
            for key, mask, pairs in rows:
                proofs.setdefault((key, mask), set()).update(pairs)
                news |= claims[key].learn([(mask, behind(p)) for p in pairs])
            if bad and not rows:
                raise RuntimeError("a dependency was found broken without a proof against it")
        if any(bad for bad, _ in found) and not news:
            raise RuntimeError("a claim was broken by proofs that were known")
    tops = placed.select(F.array(*[F.when(F.col("_at") < n, F.col(tid)) for n in sizes]).alias("t")).select([F.max(F.col("t")[i]).alias(f"t{i}") for i in range(len(sizes))]).first()
    before = base.agg(F.max(tid)).first()[0]
    out = []
    for s, n in enumerate(sizes):
        ods = cover({k: c.contexts[s] for k, c in claims.items()})
        out.append(State(n, max(t for t in (tops[s], before) if t is not None), frozenset(ods), frozenset(maximal_invalid({k: c.least[s] for k, c in claims.items()}, len(columns)))))
    for (key, mask), pairs in proofs.items():
        engine.evidence[key].add(mask, pairs)
    engine.contexts = {k: set(e.contexts) for k, e in engine.evidence.items()}
    engine.insert_judged(placed.drop("_at"))
    tables.clear()
    return out
