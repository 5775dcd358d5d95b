"""The lattice of contexts, on the driver: hitting sets, covers and maximal invalid contexts.

Only metadata is handled here. A difference set is the mask of attributes in which two violating rows
differ; a context is valid for a key if and only if it hits every difference set of the key. So the
minimal valid contexts are the minimal hitting sets, and the maximal invalid ones the complements of
the minimal difference sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from tidewright.model import Key, OrderDependency, members


def minimal(masks: Iterable[int]) -> set[int]:
    """The masks that contain no other one."""
    out: list[int] = []
    for m in sorted(set(masks), key=int.bit_count):
        if not any(o & m == o for o in out):
            out.append(m)
    return set(out)


def search(edges: Iterable[int], universe: int = -1) -> Iterator[int]:
    """The minimal sets of elements of universe that meet every edge, each once, depth first.

    Sets grow by elements of an edge they miss. Each chosen element must keep an edge that it alone meets, so no set
    is visited that a minimal one does not grow from by dropping elements; what is held is one path, not the sets found. Edges are sets of bits too.
    """
    edges = sorted(minimal(e & universe for e in edges), key=int.bit_count)
    if edges and not edges[0]:
        return
    meeting: dict[int, int] = {}  # element to the edges it is in
    for i, e in enumerate(edges):
        for v in members(e):
            meeting[v] = meeting.get(v, 0) | 1 << i

    def grow(chosen: int, alone: list[int], missed: int, free: int) -> Iterator[int]:
        """alone: for each chosen element the edges that no other one meets; missed: edges not met; free: elements that may be added."""
        if not missed:
            yield chosen
            return
        edge = min((edges[i] & free for i in members(missed)), key=int.bit_count)
        free &= ~edge
        for v in members(edge):
            kept = [x & ~meeting[v] for x in alone]
            if all(kept):
                yield from grow(chosen | 1 << v, [*kept, missed & meeting[v]], missed & ~meeting[v], free)
                free |= 1 << v

    yield from grow(0, [], (1 << len(edges)) - 1, sum(1 << v for v in meeting))


def minimal_hitting_sets(edges: Iterable[int]) -> set[int]:
    """The minimal sets that meet every edge: {0} without edges, none if an edge is empty."""
    return set(search(edges))


class HittingSets:
    """The minimal hitting sets of edges that come and go, changed by one edge at a time."""

    def __init__(self, edges: Iterable[int] = ()):
        self.edges = set(edges)
        #: the edges that contain no other one, and the sets
        self.least, self.sets = minimal(self.edges), set(search(self.edges))

    def _needed(self, chosen: int) -> bool:
        """Whether each element of a hitting set alone meets an edge."""
        met = 0
        for e in self.least:
            if (x := e & chosen) & (x - 1) == 0:
                met |= x
        return met == chosen

    def add(self, edge: int) -> None:
        """Sets that meet the new edge stay; the others grow by one of its elements, where all their elements are still needed."""
        if edge in self.edges:
            return
        self.edges.add(edge)
        if any(o & edge == o for o in self.least):
            return
        self.least = {o for o in self.least if o & edge != edge} | {edge}
        grown = {s | 1 << v for s in self.sets if not s & edge for v in members(edge)}
        self.sets = {s for s in self.sets if s & edge} | {g for g in grown if self._needed(g)}

    def remove(self, edge: int) -> None:
        """Sets whose elements are needed without the edge stay; new ones avoid it, since a set that meets it was one before."""
        self.edges.discard(edge)
        if edge not in self.least:
            return
        self.least = minimal([*(self.least - {edge}), *(e for e in self.edges if e & edge == edge)])
        self.sets = {s for s in self.sets if self._needed(s)} | set(search(self.least, ~edge))


def holds(contexts: Mapping[Key, set[int]], key: Key, context: int) -> bool:
    """Whether minimal contexts by key imply key in a context: by a smaller context, or as one side is constant."""
    keys = [key] if key.constant else [key, Key(key.left), Key(key.right)]
    return any(c & context == c for k in keys for c in contexts.get(k, ()))


def cover(contexts: Mapping[Key, set[int]]) -> set[OrderDependency]:
    """The minimal cover of the minimal valid contexts of every key: those that a constant side implies are left out."""
    out = set()
    for key, found in contexts.items():
        sides = [] if key.constant else [c for k in (Key(key.left), Key(key.right)) for c in contexts.get(k, ())]
        out |= {OrderDependency(key, x) for x in found if not any(c & x == c for c in sides)}
    return out


def contexts_of(ods: Iterable[OrderDependency], keys: Iterable[Key]) -> dict[Key, set[int]]:
    """The minimal valid contexts of keys from a minimal cover: a compatible key has those of its sides too."""
    own: dict[Key, set[int]] = {}
    for od in ods:
        own.setdefault(od.key, set()).add(od.context)
    out = {}
    for key in keys:
        found = set(own.get(key, ()))
        if not key.constant:
            # a side's constancy in a context with the other side says nothing: contexts leave both sides out
            found |= {c for k in (Key(key.left), Key(key.right)) for c in own.get(k, ()) if not c & key.mask}
        out[key] = minimal(found)
    return out


def evidence_of(contexts: Mapping[Key, set[int]]) -> dict[Key, set[int]]:
    """The minimal difference sets of each key from its minimal valid contexts; hitting sets are their own inverse."""
    return {key: minimal_hitting_sets(found) if found else {0} for key, found in contexts.items()}


def maximal_invalid(evidence: Mapping[Key, set[int]], n: int) -> set[OrderDependency]:
    """For each key the maximal contexts in which it does not hold, from its difference sets."""
    return {OrderDependency(key, (1 << n) - 1 & ~key.mask & ~e) for key, found in evidence.items() for e in minimal(found)}
