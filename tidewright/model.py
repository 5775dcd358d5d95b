"""Order dependencies: their parts, text form and bit masks.

A context is a set of attributes, kept as a bit mask over attribute positions. A constant dependency
{X}: [] ↦ A says that A has one value in every class of X. A compatible one, {X}: A↑ ~ B↑ or A↑ ~ B↓,
says that no class of X has a swap: two rows ordered one way by A and the wrong way by B.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

UP, DOWN = "↑", "↓"


@dataclass(frozen=True, order=True)
class Key:
    """A dependency without its context: (left,) is constant; (left, right) with left < right is compatible."""

    left: int
    right: int = -1
    same: bool = True

    @property
    def constant(self) -> bool:
        return self.right < 0

    @property
    def mask(self) -> int:
        return 1 << self.left | (0 if self.constant else 1 << self.right)


@dataclass(frozen=True, order=True)
class OrderDependency:
    key: Key
    context: int = 0


def constant(context: Iterable[int], attribute: int) -> OrderDependency:
    return OrderDependency(Key(attribute), to_mask(context))


def compatible(context: Iterable[int], one: int, two: int, same: bool = True) -> OrderDependency:
    return OrderDependency(Key(min(one, two), max(one, two), same), to_mask(context))


def to_mask(attributes: Iterable[int]) -> int:
    out = 0
    for a in attributes:
        out |= 1 << a
    return out


def members(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def all_keys(n: int) -> list[Key]:
    """The n constant keys and the n(n-1) compatible ones."""
    return [Key(a) for a in range(n)] + [Key(a, b, s) for a in range(n) for b in range(a + 1, n) for s in (True, False)]


def trivial(n: int) -> set[OrderDependency]:
    """The cover of a table of at most one row."""
    return {OrderDependency(Key(a)) for a in range(n)}


def to_text(od: OrderDependency, names: Sequence[str]) -> str:
    context = ", ".join(names[i] for i in members(od.context))
    if od.key.constant:
        return f"{{{context}}}: [] ↦ {names[od.key.left]}"
    return f"{{{context}}}: {names[od.key.left]}{UP} ~ {names[od.key.right]}{UP if od.key.same else DOWN}"


_TEXT = re.compile(r"\s*\{(?P<context>[^{}]*)\}\s*:\s*(?:\[\s*\]\s*↦(?P<fixed>.+)|(?P<one>[^~]+)~(?P<two>[^~]+))")


def parse(text: str, names: Sequence[str]) -> OrderDependency | None:
    """The dependency that text says; None if it says none, or names an unknown attribute."""
    found, places = _TEXT.fullmatch(text), {name: i for i, name in enumerate(names)}
    if not found:
        return None
    context = [places.get(x.strip()) for x in found["context"].split(",") if x.strip()]
    sides = [found["fixed"]] if found["fixed"] is not None else [found["one"], found["two"]]
    arrows = []
    if found["fixed"] is None:
        sides = [s.strip() for s in sides]
        arrows = [s[-1:] for s in sides]
        if any(a not in (UP, DOWN) for a in arrows):
            return None
        sides = [s[:-1] for s in sides]
    ends = [places.get(s.strip()) for s in sides]
    if None in context or None in ends:
        return None
    if not arrows:
        return constant(context, ends[0])
    return compatible(context, ends[0], ends[1], arrows[0] == arrows[1]) if ends[0] != ends[1] else None


SCHEMA = "od string, kind string, context array<string>, lhs string, rhs string, same_direction boolean"


def to_frame(spark: SparkSession, ods: Iterable[OrderDependency], names: Sequence[str]) -> DataFrame:
    """A row for each dependency."""
    rows = []
    for od in sorted(ods):
        context, c = [names[i] for i in members(od.context)], od.key.constant
        rows.append((to_text(od, names), "constant" if c else "compatible", context, None if c else names[od.key.left], names[od.key.left] if c else names[od.key.right], None if c else od.key.same))
    return spark.createDataFrame(rows, SCHEMA)
