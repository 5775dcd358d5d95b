"""Covers by definition, for small tables."""

from itertools import combinations

from tidewright.model import Key, OrderDependency, all_keys, members


def holds(rows, key, context):
    classes = {}
    for r in rows:
        classes.setdefault(tuple(r[i] for i in members(context)), []).append(r)
    for group in classes.values():
        for s, t in combinations(group, 2):
            if key.constant:
                if s[key.left] != t[key.left]:
                    return False
            else:
                a, b = s[key.left] - t[key.left], s[key.right] - t[key.right]
                if (a * b < 0) if key.same else (a * b > 0):
                    return False
    return True


def cover(rows, n):
    valid = {}
    for key in all_keys(n):
        found = [c for c in range(1 << n) if not c & key.mask and holds(rows, key, c)]
        valid[key] = [c for c in found if not any(o != c and o & c == o for o in found)]
    out = set()
    for key, found in valid.items():
        sides = [] if key.constant else [c for k in (Key(key.left), Key(key.right)) for c in valid[k]]
        out |= {OrderDependency(key, c) for c in found if not any(s & c == s for s in sides)}
    return out


def maximal_invalid(rows, n):
    out = set()
    for key in all_keys(n):
        bad = [c for c in range(1 << n) if not c & key.mask and not holds(rows, key, c)]
        out |= {OrderDependency(key, c) for c in bad if not any(o != c and o & c == c for o in bad)}
    return out
