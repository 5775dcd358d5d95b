"""Secret scan by assignment-aware lexing.

Base patterns find assignments to well-known names, access key ids and long hexadecimal runs.
The lexer adds what they miss: at each assignment sign it reads the name before and the literal
behind (quoted, bare, or a sum of both), follows constants through a table of all names that the text assigns
(the last assignment before the use, else the first one behind it), and scores the literal by how sensitive the
name it reaches is and how random it looks. A value put together from constants is scored by what adds up over
its parts (see Value), so it is judged whole, however long or often repeated.

Texts are independent, so the scan runs as an Arrow-batched function in each task, without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "lexed", "propagated")
BASE_KINDS = KINDS[:3]
THRESHOLD = 0.7
REDACTED = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters: a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")

_SIGN = re.compile(r"[:=]")
# the name before a sign, with its type if it has one, read backwards in the reversed text
_NAME_BEHIND = re.compile(r""":?(?:[ \t]*[\w.\[\]|]*[A-Za-z_][ \t]*:)?[ \t]*\]?["'`]?([\w$]*[A-Za-z_$](?:[.-][\w$]*[A-Za-z_$])*)""")
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.\[\]|]*[ \t]*=(?!=)[ \t]*\S")  # behind a colon: a type, not a value
_GAP = re.compile(r"[ \t]*")
_QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>+]+""")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_REFERENCE = re.compile(r"\$\{(\w+)\}|\$(\w+)|%\((\w+)\)s|\{\{\s*(\w+)\s*\}\}")
_WORD = re.compile(r"[\w$.-]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_EDGE = 16  # characters kept of a value's ends: as long as the longest stand-in
#: Characters that are counted apart in values that are put together.
FOLD = 256

#: Parts of names and how sensitive they are.
NAME_WEIGHTS = {"password": 0.6, "passwd": 0.6, "pwd": 0.6, "passphrase": 0.6, "secret": 0.6, "token": 0.55, "apikey": 0.6, "credential": 0.5, "credentials": 0.5, "bearer": 0.5, "auth": 0.4, "signature": 0.35, "salt": 0.3}
PAIR_WEIGHTS = {("api", "key"): 0.6, ("private", "key"): 0.6, ("access", "key"): 0.6, ("secret", "key"): 0.65, ("signing", "key"): 0.55, ("encryption", "key"): 0.55, ("client", "secret"): 0.65, ("conn", "string"): 0.5, ("connection", "string"): 0.5}
#: What stands where a secret would.
_STANDS_IN = re.compile(r"example|sample|changeme|change_me|placeholder|your[_-]|dummy|redacted|xxxx|\*{3}", re.IGNORECASE)
_STANDS_IN_ANYWHERE = re.compile(f"(?={_STANDS_IN.pattern})", re.IGNORECASE)
_NOTHING = re.compile(r"none|null|nil|true|false|undefined|required|optional|string|str|bytes", re.IGNORECASE)

SPAN = T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("start", "end", "value_start", "value_end")), T.StructField("score", T.DoubleType())])
SCAN = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    one = max((NAME_WEIGHTS.get(p, 0.0) for p in parts), default=0.0)
    return max(one, max((PAIR_WEIGHTS.get(p, 0.0) for p in zip(parts, parts[1:])), default=0.0))


def _fold(counts: Counter) -> Counter:
    """Counts of at most FOLD characters: those of larger alphabets share places, so that values add up in bounded time."""
    if len(counts) <= FOLD:
        return counts
    out: Counter = Counter()
    for c, n in counts.items():
        out[chr(ord(c) % FOLD)] += n
    return out


def _log(n: int) -> float:
    return n * math.log2(n) if n else 0.0


@dataclass(frozen=True)
class Value:
    """What the score of a text needs of it; adds up over the parts of a text.

    counts: of its characters, where other values are made of it; weight: the sum of n * log2(n) over them. first and last: its ends.
    """

    length: int = 0
    counts: Counter | None = field(default_factory=Counter)
    weight: float = 0.0
    first: str = ""
    last: str = ""
    stands_in: bool = False
    is_url: bool = False
    has_digit: bool = False
    has_letter: bool = False
    has_space: bool = False

    @classmethod
    def of(cls, text: str) -> Value:
        counts = Counter(text)
        kinds = [any(map(f, counts)) for f in (str.isdigit, str.isalpha, str.isspace)]
        counts = _fold(counts)
        return cls(len(text), counts, sum(map(_log, counts.values())), text[:_EDGE], text[-_EDGE:], _STANDS_IN.search(text) is not None, "://" in text, *kinds)

    def __add__(self, other: Value) -> Value:
        if not self.length or not other.length:
            return self if self.length else other
        seam, counts = self.last + other.first, _fold(self.counts + other.counts)
        return Value(
            self.length + other.length, counts, sum(map(_log, counts.values())), (self.first + other.first)[:_EDGE], seam[-_EDGE:] if other.length < _EDGE else other.last,
            self.stands_in or other.stands_in or _STANDS_IN.search(seam) is not None, self.is_url or other.is_url or "://" in seam,
            self.has_digit or other.has_digit, self.has_letter or other.has_letter, self.has_space or other.has_space,
        )

    def score(self) -> float:
        """How much the text looks like a secret: long, random and mixed speaks for it; words, paths and stand-ins against."""
        n = self.length
        if n < 6 or self.stands_in or self.first.startswith("<") or (n <= _EDGE and _NOTHING.fullmatch(self.first)):
            return -1.0
        bits = round(math.log2(n) - self.weight / n, 9)
        out = 0.1 + (0.1 if n >= 12 else 0.0) + (0.2 if bits > 3.0 else 0.1 if bits > 2.5 else 0.0)
        out += 0.15 if self.has_digit and self.has_letter else 0.0
        out -= 0.4 if self.has_space else 0.0
        return out - (0.3 if self.is_url or self.first.startswith("/") else 0.0)


@dataclass(eq=False)
class _Literal:
    """A literal and what is added to it: its place; a quoted one may hold references, a bare one may be one.

    Bare literals that begin at signs inside one run of characters all end with it and share what follows. known: the
    value of the literal and all behind it, the first place it is written at, whether it follows a constant, and is quoted.
    """

    start: int
    end: int
    quoted: bool
    behind: _Literal | None = None
    #: places of references in the text, and the literals they mean
    uses: list[tuple[int, int, _Literal]] = field(default_factory=list)
    is_used: bool = False
    known: tuple[Value, tuple[int, int] | None, bool, bool] | None = None
    told: bool = False

    def places(self) -> list[tuple[int, int]]:
        """Where the literal itself is written: here, or where the constants are that it is made of."""
        own = [(self.start, self.end)] if self.quoted or not self.uses else []
        return list(dict.fromkeys(own + [u.known[1] for _, _, u in self.uses if u.known and u.known[1]]))


class _Literals:
    """The literals of a text, each read once."""

    def __init__(self, text: str):
        self.text, self.at = text, {}
        self.runs = [m.span() for m in _BARE.finditer(text)]
        self.begins = [a for a, _ in self.runs]

    def _one(self, at: int) -> _Literal | None:
        """The literal that starts at a place, known or new."""
        if at in self.at or at >= len(self.text):
            return self.at.get(at)
        made = None
        if self.text[at] in "\"'`":
            m = _QUOTED.match(self.text, at)
            made = m and _Literal(*m.span(2), True)
        elif (k := bisect_right(self.begins, at) - 1) >= 0 and at < self.runs[k][1]:
            made = _Literal(at, self.runs[k][1], False)
        self.at[at] = made
        return made

    def chain(self, at: int) -> _Literal | None:
        """The literal behind the blanks at a place, linked to those added to it."""
        first = self._one(_GAP.match(self.text, at).end())
        one = first
        while one is not None and one.behind is None:
            plus = _PLUS.match(self.text, one.end + one.quoted)
            one.behind = self._one(plus.end()) if plus else None
            one = one.behind
        return first


def _assignments(text: str) -> tuple[list[tuple[str, int, _Literal]], _Literals]:
    """The name, the sign's place and the first literal of all assignments of a text, in order; all literals."""
    out, size, behind, literals = [], len(text), text[::-1], _Literals(text)
    for m in _SIGN.finditer(text):
        i = m.start()
        after, before = text[i + 1 : i + 2], text[i - 1 : i]
        if after == "=" or before in ("=", "!", "<", ">") or (m[0] == ":" and (text[i + 1 : i + 3] == "//" or _TYPE.match(text, i + 1))):
            continue
        named = _NAME_BEHIND.match(behind, size - i)
        first = named and literals.chain(i + 1 + (m[0] == "=" and after == ">"))
        if first:
            out.append((named[1][::-1], i, first))
    return out, literals


def _find_uses(text: str, made: list[tuple[str, int, _Literal]], literals: list[_Literal]) -> None:
    """Fills in which constants literals name: the last assignment of the name before the literal's own, else the first behind it."""
    places: dict[str, list[int]] = {}  # of a name, whole and by its last part, in the assignments
    for k, (name, _, _) in enumerate(made):
        for n in dict.fromkeys((name, name.rpartition(".")[2])):
            places.setdefault(n, []).append(k)
    signs = [i for _, i, _ in made]

    def constant(name: str, start: int) -> _Literal | None:
        k = bisect_left(signs, start) - 1
        for n in dict.fromkeys((name, name.rpartition(".")[2])):
            own = places.get(n, ())
            if (j := bisect_left(own, k)) > 0:
                return made[own[j - 1]][2]
            j += j < len(own) and own[j] == k
            if j < len(own):
                return made[own[j]][2]
        return None

    for one in literals:
        if one.quoted:
            found = [(*m.span(), next(filter(None, m.groups()))) for m in _REFERENCE.finditer(text, one.start, one.end)]
        elif (word := _WORD.match(text, one.start, one.end)) and word.end() == one.end:
            found = [(one.start, one.end, word[0][1:] if re.fullmatch(r"\$\w+", word[0]) else word[0])]
        else:
            found = []
        one.uses = [(a, b, u) for a, b, name in found if (u := constant(name, one.start))]
        for _, _, u in one.uses:
            u.is_used = True
        if one.behind:
            one.behind.is_used = True


def _evaluate(text: str, first: _Literal, by_end: dict[int, list[_Literal]]) -> None:
    """Makes the value of a literal known, and those it is made of before it; a constant made of itself is read as far as it is known."""
    waiting, open_ = [first], set()
    while waiting:
        one = waiting[-1]
        if one.known:
            waiting.pop()
            continue
        if one not in open_:
            open_.add(one)
            needed = [x for x in (one.behind, *(u for _, _, u in one.uses)) if x and not x.known and x not in open_]
            if needed:
                waiting += needed
                continue
        rest = one.behind.known if one.behind and one.behind.known else (Value(), None, False, False)
        if one.quoted or one.uses:
            value, at, used = Value(), one.start, [(a, b, u.known) for a, b, u in one.uses if u.known]
            for a, b, (inner, _, _, _) in used:
                value, at = value + Value.of(text[at:a]) + inner, b
            value = value + Value.of(text[at : one.end])
            place = next(iter(one.places()), rest[1])
            one.known = (value + rest[0], place, bool(used) or rest[2], one.quoted or rest[3] or any(u[3] for _, _, u in used))
        else:
            _evaluate_run(text, [x for x in by_end[one.end] if not x.known and not x.uses], rest)
        waiting.pop()


def _evaluate_run(text: str, ones: list[_Literal], rest: tuple[Value, tuple[int, int] | None, bool, bool]) -> None:
    """The values of bare literals of one run (and of what is added behind it), from the last to the first in one pass."""
    ones = sorted(ones, key=lambda x: -x.start)
    begin, end, tail = ones[-1].start, ones[0].end, rest[0]
    stand_in = max((m.start() for m in _STANDS_IN_ANYWHERE.finditer(text, begin, end) if _STANDS_IN.match(text, m.start(), end)), default=-1)
    url = text.rfind("://", begin, end)
    seam = text[max(begin, end - _EDGE) : end] + tail.first
    counts, weight, at = Counter(tail.counts), tail.weight, end
    digit, letter, space = tail.has_digit, tail.has_letter, tail.has_space
    for one in ones:
        for c in text[one.start : at]:
            place = c if c in counts or len(counts) < FOLD else chr(ord(c) % FOLD)
            n = counts[place]
            counts[place] = n + 1
            weight += _log(n + 1) - _log(n)
            digit, letter, space = digit or c.isdigit(), letter or c.isalpha(), space or c.isspace()
        at = one.start
        own = text[max(at, end - _EDGE) : end]
        across = seam[len(seam) - len(own) - len(tail.first) :]
        value = Value(
            end - at + tail.length, Counter(counts) if one.is_used else None, weight, (text[at : min(end, at + _EDGE)] + tail.first)[:_EDGE], (own + tail.first)[-_EDGE:] if tail.length < _EDGE else tail.last,
            at <= stand_in or tail.stands_in or (bool(tail.first) and _STANDS_IN.search(across) is not None), at <= url or tail.is_url or (bool(tail.first) and "://" in across), digit, letter, space,
        )
        one.known = (value, (at, end), rest[2], rest[3])


def lex(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the literals that reach a sensitive name with a score of THRESHOLD or more.

    Time grows nearly in proportion to the text: signs inside one run of characters share its end, added literals are linked, and
    those that a sensitive name before has told already are not told again.
    """
    made, literals = _assignments(text)
    every = list({id(x): x for x in literals.at.values() if x}.values())
    _find_uses(text, made, every)
    by_end: dict[int, list[_Literal]] = {}
    for one in every:
        if not one.quoted:
            by_end.setdefault(one.end, []).append(one)
    for _, _, first in made:
        _evaluate(text, first, by_end)
    for name, _, one in made:
        weight = name_weight(name)
        value, _, followed, quoted = one.known
        if weight and (quoted or value.has_digit) and (score := weight + value.score()) >= THRESHOLD:
            while one is not None and not one.told:
                for start, end in one.places():
                    yield "propagated" if followed else "lexed", start, end, round(score, 4)
                one.told = True
                one = one.behind


def scan(text: str | None) -> list[tuple[str, int, int, int, int, float]]:
    """(kind, start, end, value_start, value_end, score) in code points by start, then kind; base matches have score 1."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), *m.span(2), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        starts, ends = [x[1] for x in found], [x[2] for x in found]
        added = {}
        for kind, start, end, score in lex(text):
            if end > start and (start, end) not in added and not ((k := bisect_right(starts, start)) and end <= ends[k - 1]):
                added[start, end] = (kind, start, end, start, end, score)
        found += added.values()
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), *m.span(), 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, spans: list) -> str | None:
    """text with every value found replaced; values that overlap are replaced once."""
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted((x[3], x[4]) for x in spans):
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(SCAN)
def _scan(texts: pd.Series) -> pd.DataFrame:
    found = [scan(t) for t in texts]
    return pd.DataFrame({"spans": [[dict(zip(SPAN.names, x)) for x in f] for f in found], "redacted": [redact(t, f) for t, f in zip(texts, found)]})


def scan_column(text: Column) -> Column:
    """A struct of spans (array, empty if none) and redacted (the text without the values found; null stays null)."""
    return _scan(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans and redacted for every row of docs; repeated rows stay.

    Null and empty texts have no spans, an empty table has no rows. A text is scanned whole, however long. Other columns are not looked at.
    """
    return docs.select(F.col(id_col), scan_column(F.col(text_col)).alias("r")).select(id_col, "r.spans", "r.redacted")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of find_secrets."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", *map(count, BASE_KINDS), F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))
