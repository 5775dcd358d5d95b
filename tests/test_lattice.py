import random

from tests import brute
from tidewright.model import Key, OrderDependency, all_keys, compatible, constant, members, parse, to_mask, to_text
from tidewright.plans.lattice import HittingSets, contexts_of, cover, evidence_of, holds, maximal_invalid, minimal, minimal_hitting_sets, search


def test_minimal_hitting_sets():
    sets = lambda *edges: {tuple(members(m)) for m in minimal_hitting_sets(map(to_mask, edges))}
    assert sets() == {()}
    assert sets({1}) == {(1,)}
    assert sets({1, 2, 3}) == {(1,), (2,), (3,)}
    assert sets({1}, {2}) == {(1, 2)}
    assert sets({1, 2}, {2}) == {(2,)}
    assert sets({1, 2}, {2, 3}, {1, 3}) == {(1, 2), (1, 3), (2, 3)}
    assert sets({1, 2}, {1, 3, 4}, {1, 4, 5}) == {(1,), (2, 4), (2, 3, 5)}
    assert sets({1}, set()) == set()


def test_hitting_sets_against_all_subsets():
    r = random.Random(3)
    for _ in range(300):
        edges = [r.randrange(64) for _ in range(r.randint(0, 5))]
        hits = [s for s in range(64) if all(s & e for e in edges)]
        assert minimal_hitting_sets(edges) == {s for s in hits if not any(o != s and o & s == o for o in hits)}


def test_edges_come_and_go():
    r = random.Random(7)
    for _ in range(150):
        kept, edges = HittingSets(first := [r.randrange(128) for _ in range(r.randint(0, 3))]), set(first)
        for _ in range(12):
            if edges and r.random() < 0.45:
                edges.remove(e := r.choice(sorted(edges)))
                kept.remove(e)
            else:
                edges.add(e := r.randrange(r.choice((8, 128))))
                kept.add(e)
            assert kept.sets == minimal_hitting_sets(edges) and kept.least == minimal(edges)


def test_search_of_thirty_columns():
    r = random.Random(11)
    edges = [sum(1 << v for v in r.sample(range(30), r.randint(3, 8))) for _ in range(14)]
    found, kept = list(search(edges)), HittingSets()
    for e in edges:
        kept.add(e)
    assert len(found) == len(set(found)) > 1000 and set(found) == kept.sets
    for s in r.sample(found, 200):
        assert all(s & e for e in edges) and not any(all((s & ~(1 << v)) & e for e in edges) for v in members(s))
    some = search([1 << 2 * i | 1 << 2 * i + 1 for i in range(31)])  # two to the 31 sets: taken one after another, none held
    assert len({next(some) for _ in range(1000)}) == 1000


def test_text_form():
    names = ["active", "franchID", "franchName", "NAassoc", "score"]
    for text, od in [
        ("{franchID}: [] ↦ NAassoc", constant([1], 3)),
        ("{active, franchID}: [] ↦ NAassoc", constant([0, 1], 3)),
        ("{}: [] ↦ score", constant([], 4)),
        ("{franchID }: [] ↦ NAassoc  ", constant([1], 3)),
        ("{active, franchName}: franchID↑ ~ NAassoc↑", compatible([0, 2], 1, 3)),
        ("{active}: franchID↓ ~ NAassoc↓", compatible([0], 1, 3)),
        ("{active, franchName}: franchID↑ ~ NAassoc↓", compatible([0, 2], 1, 3, False)),
        ("{}: franchID↑ ~ score↓", compatible([], 1, 4, False)),
        ("{ active , franchName }: franchID ↑ ~ NAassoc↓", compatible([0, 2], 1, 3, False)),
    ]:
        assert parse(text, names) == od
        assert parse(to_text(od, names), names) == od
    for text in ("{nope}: [] ↦ score", "{}: [] ↦ nope", "{active}: franchID ~ NAassoc", "{active}: franchID ↦ NAassoc", "{active}: franchID↑ NAassoc↓", "not a valid format", ""):
        assert parse(text, names) is None


def test_duality_on_random_tables():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(2, 4)
        rows = [tuple(r.randrange(3) for _ in range(n)) for _ in range(r.randint(0, 6))]
        ods = brute.cover(rows, n)
        contexts = contexts_of(ods, all_keys(n))
        assert cover(contexts) == ods
        assert maximal_invalid(evidence_of(contexts), n) == brute.maximal_invalid(rows, n)
        for key in all_keys(n):
            for c in range(1 << n):
                if not c & key.mask:
                    assert holds(contexts, key, c) == brute.holds(rows, key, c)
    assert OrderDependency(Key(0)) in cover({Key(0): {0}})
