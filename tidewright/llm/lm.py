"""Language-model scoring by causal self-attention, trained in numpy on subword ids.

Words are cut into subwords of a public vocabulary by longest match (its single bytes leave nothing
out). The model is one layer of causal self-attention with learned relative places: from the subwords
before, it gives the class of the next one, in two steps (its group of classes, then the class in it);
within a class subwords have their share of the training corpus, so the probabilities of all subwords sum
to one. Frequent subwords are classes of their own. A word's probability is that of its subwords and of its
end (the next subword begins a word); as usual it is interpolated with the word's share of the training
corpus, so words met often are not spelled out.

Scoring cuts a text into windows of WINDOW subwords, each STEP behind the last: the last STEP of a
window are scored (each subword once), the ones before are context. A class attends to a class by one
entry of a table, the exponential of query times key, so a batch of windows is a few look-ups and
masked matrix products.

Texts are cut once, into a table of subword ids; what follows knows a word by its ids.

Training: word counts, and from them subword counts and classes, cover every training document. So do the
weights: each document is met once, in one of ROUNDS rounds. A round deals its documents by a hash into
folds of FOLD_WORDS words, a task trains the round's weights on a fold, and the folds' weights are averaged on the
cluster. Rounds, folds and the order in a fold follow from the rows alone, so the model does not depend on cores or files.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Tables

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents with this remainder of crc32(id) modulo PARTS are held out.
PARTS, HELD_OUT = 7, 2
#: Groups of classes whose subwords begin words (or end a text), and of others; classes in a group.
BEGIN_GROUPS, OTHER_GROUPS, GROUP = 8, 7, 16
GROUPS = BEGIN_GROUPS + OTHER_GROUPS
CLASSES = GROUPS * GROUP
#: The last classes of either kind hold many subwords of like counts, all others one.
BANDS = 12
BEGIN, PAD, SYMBOLS = CLASSES, CLASSES + 1, CLASSES + 2
WINDOW, STEP, HEADS, KEY, WIDTH = 32, 16, 2, 8, 32
PART = WIDTH // HEADS  # of the hidden row, a head's values
#: Training: rounds of averaging, words of a fold on average, documents whose windows are mixed, and windows in a step.
ROUNDS, FOLD_WORDS, MIXED, BATCH = 4, 400_000, 1024, 512
PHASE = 512  # windows scored at once
MIX = math.log(0.5)  # of a word's share of the corpus, and of the attention's probability
#: Words counted so often that at most so many are, are looked up in a broadcast table; the rest are joined.
FREQUENT = 300_000
#: Words whose subwords a Python worker remembers; a full memory is counted and emptied, which costs time only.
REMEMBERED = 400_000


def is_held_out(key: Column) -> Column:
    """Whether a document is held out; a null id counts as an empty one."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % PARTS == HELD_OUT


def keep_freed() -> None:
    """Lets the process keep what its arrays free: glibc holds on to blocks as large as the largest one freed so far, up to 32 MB.
    Otherwise the arrays of each step are returned to the system and come back as pages that it clears, a few thousand a step."""
    np.empty((1 << 25) - (1 << 16), np.uint8)


_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SYMBOL = _mix(np.arange(1 << 16, dtype=_U) * _GOLDEN + _U(1))
_GAP = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LETTER = np.where(_GAP, _U(0), _SYMBOL[:256])  # the gap behind a word adds nothing


def names_of(symbols: np.ndarray, starts: np.ndarray, table: np.ndarray = _SYMBOL) -> np.ndarray:
    """A 64-bit name of each word: symbols (bytes or ids) hold the words, which begin at starts and reach to the next one;
    table: what a symbol adds, times a power for its place."""
    if not len(starts):
        return np.zeros(0, _U)
    symbols = symbols[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    powers = np.ones(int(place.max()) + 1, _U)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, _GOLDEN, _U))
    return _mix(np.add.reduceat(table[symbols] * powers[place], starts))


def split_texts(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as UTF-8 with A-Z in lower case, in one row; where words begin and end in it; and how many words each text has."""
    parts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    line = b" ".join([*parts, b""])
    gap = _GAP[np.frombuffer(line, np.uint8)]
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.append(0, np.cumsum([len(x) + 1 for x in parts])))
    return line, starts, ends, np.diff(bounds)


class Subwords:
    """The subwords of a vocabulary file: pieces without A-Z or inner white space. The last id is the end of a text."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.end = len(pieces)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.begins = np.array([p[:1] == b" " for p in pieces], bool)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Subwords:
        with open(path, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]) for line in lines]
        kept = [p for p in pieces if p == p.lower() and not p[1:].translate(None, b"\t\n\x0b\x0c\r ") != p[1:]]
        return cls(sorted(set(kept) | {bytes([b]) for b in range(256)}))

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of words (each behind a space), and where each word's begin."""
        line = b" " + b" ".join(words)
        ids = np.array([v for _, v in self.automaton.iter_long(line.decode("latin-1"))], dtype=np.uint16)
        return ids, np.flatnonzero(self.begins[ids])


class Memory:
    """Numbers of the words met in a task, and by number a word's subwords (CSR)."""

    def __init__(self, subwords: Subwords):
        self.subwords = subwords
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words; new words are cut and get the next ones."""
        found = list(map(self.number.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, n in zip(words, found) if n is None))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            ids, begins = self.subwords.cut(new)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.append(begins[1:], len(ids))])
            self.flat = np.concatenate([self.flat, ids])
            found = list(map(self.number.get, words))
        return np.array(found, np.int64)

    def subwords_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of words in a row, and how many each word has."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.flat[at], sizes


@dataclass
class Classes:
    """Of each subword its class and the log of its share of it; of each class the log of its share of the corpus."""

    of: np.ndarray
    within: np.ndarray
    share: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, begins: np.ndarray) -> Classes:
        """Subwords that begin words (begins; the end of a text does) have the classes of the first BEGIN_GROUPS groups,
        others those behind. Of either kind the most frequent ones are classes of their own; the rest fall into BANDS of like counts."""
        mass = counts + 0.5
        of = np.zeros(len(mass), np.int64)
        for first, size, kind in ((0, BEGIN_GROUPS * GROUP, True), (BEGIN_GROUPS * GROUP, OTHER_GROUPS * GROUP, False)):
            own = np.flatnonzero(begins == kind)
            order = own[np.argsort(-mass[own], kind="stable")]
            single, rest = order[: size - BANDS], order[size - BANDS :]
            of[single] = first + np.arange(len(single))
            before = np.cumsum(mass[rest]) - mass[rest]
            of[rest] = first + size - BANDS + np.minimum(BANDS - 1, (BANDS * before / max(1.0, mass[rest].sum())).astype(np.int64))
        total = np.bincount(of, mass, CLASSES)
        return cls(of.astype(np.uint8), np.log(mass / total[of]), np.log((total + 0.5) / (total + 0.5).sum()))


def begins_word(classes: np.ndarray) -> np.ndarray:
    return classes < BEGIN_GROUPS * GROUP


def inputs_and_starts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts (classes of their subwords) laid out in one row of inputs, padded so that all windows lie inside; the
    windows' starts; the targets of each window's last STEP places (PAD: none); and the text of each window."""
    sizes = np.array([len(c) for c in classes], np.int64)
    windows = -(-sizes // STEP)
    room = WINDOW - STEP + windows * STEP
    at = np.cumsum(room) - room
    row = np.full(int(room.sum()) + 1, PAD, np.uint8)
    goal = np.full(int(windows.sum()) * STEP, PAD, np.uint8)
    goal_at = (np.cumsum(windows) - windows) * STEP
    for c, a, g in zip(classes, at + WINDOW - STEP, goal_at):
        row[a] = BEGIN
        row[a + 1 : a + len(c)] = c[:-1]
        goal[g : g + len(c)] = c
    text = np.repeat(np.arange(len(classes)), windows)
    starts = np.repeat(at, windows) + (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP
    return row, starts, goal.reshape(-1, STEP), text


_SHAPES = {"query": (HEADS, SYMBOLS, KEY), "key": (HEADS, SYMBOLS, KEY), "value": (HEADS, SYMBOLS, PART), "own": (SYMBOLS, WIDTH), "place": (HEADS, WINDOW), "group": (WIDTH + 1, GROUPS), "member": (GROUPS, WIDTH + 1, GROUP)}
_SIZE = sum(math.prod(shape) for shape in _SHAPES.values())
#: How far the query at STEP place i lies behind the key at window place j; negative ones are masked.
_BEHIND = (np.arange(STEP)[:, None] + WINDOW - STEP) - np.arange(WINDOW)[None, :]
_MOST = 60.0  # of an exponent


def _named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of one row."""
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        out[k] = flat[at : (at := at + math.prod(shape))].reshape(shape)
    return out


def _shares(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits (changed in place) and the log of its sum; logits that could overflow are moved below 0."""
    if max(float(logits.max(initial=0.0)), -float(logits.min(initial=0.0))) > _MOST:
        logits -= logits.max(1, keepdims=True)
    e = np.exp(logits)
    return e, np.log(e @ np.ones((e.shape[1], 1), e.dtype) + e.dtype.type(1e-30))[:, 0]


def _squash(x: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    x /= 1.0 + np.abs(x)


def _by_group(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of goals that are none of padding, by group; their groups, their places in them, and where each group begins."""
    g = goal.reshape(-1)
    real = np.flatnonzero(g != PAD)
    real = real[np.argsort(g[real] // GROUP, kind="stable")]
    of, within = np.divmod(g[real].astype(np.intp), GROUP)
    return real, of, within, np.searchsorted(of, np.arange(GROUPS + 1))


def _summed(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each class (ids, a byte each), which are put beside each other first."""
    ids = ids.ravel()
    counts = np.bincount(ids, minlength=SYMBOLS)
    met = np.flatnonzero(counts)
    out = np.zeros((SYMBOLS, rows.shape[1]), rows.dtype)
    if len(met):
        out[met] = np.add.reduceat(np.take(rows, np.argsort(ids, kind="stable"), axis=0), (np.cumsum(counts) - counts)[met], axis=0)
    return out


class Attention:
    """One layer of causal self-attention over classes; flat: its weights in one row, w: by name.

    The last rows of group and member are biases: a group's logits are its column times the hidden row, a class's those of
    its group's member table.
    """

    def __init__(self, flat: np.ndarray):
        self.flat, self.w = flat, _named(flat)

    @classmethod
    def initial(cls, share: np.ndarray, seed: int = 5) -> Attention:
        r = np.random.default_rng(seed)
        out = cls(np.zeros(_SIZE, np.float32))
        for k, x in out.w.items():
            x[:] = r.standard_normal(x.shape) * (0.3 if k in ("query", "key", "value", "own") else 0.05)
        out.w["place"] -= 0.2 * np.arange(WINDOW) * np.array([[1.0], [0.1]])[:HEADS]
        mass = np.exp(share).reshape(GROUPS, GROUP)
        out.w["group"][-1] = np.log(mass.sum(1))
        out.w["member"][:, -1] = np.log(mass / mass.sum(1, keepdims=True))
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By head: how much a class attends to a class (padding: nothing), and to a place (ones to come: nothing)."""
        one = self.w["query"] @ self.w["key"].transpose(0, 2, 1)
        np.minimum(one, _MOST, out=one)
        np.exp(one, out=one)
        one[:, :, PAD] = 0.0
        return one, np.where(_BEHIND >= 0, np.exp(np.minimum(self.w["place"], _MOST))[:, np.maximum(_BEHIND, 0)], 0.0).astype(one.dtype)

    @cached_property
    def scoring(self) -> tuple[np.ndarray, np.ndarray]:
        """The tables of attention, kept for scoring: its weights do not change."""
        return self.tables()

    def _attend(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple:
        """Of windows x: their last STEP places, the entries of the table that these meet, by head the attention there, its
        sums and the values, and the means of values, head beside head."""
        one, place = tables
        own = x[:, WINDOW - STEP :]
        pair = own[:, :, None] * SYMBOLS + x[:, None, :]
        mean, sums = np.empty((*own.shape, WIDTH), one.dtype), np.empty((*own.shape, HEADS, 1), one.dtype)
        ones, met, values = np.ones((WINDOW, 1), one.dtype), [], []
        for h in range(HEADS):
            p, v = np.take(one[h].ravel(), pair, mode="clip"), np.take(self.w["value"][h], x, axis=0)  # clip is numpy's fast path: no index is out of bounds
            p *= place[h]
            np.matmul(p, v, out=mean[:, :, h * PART : (h + 1) * PART])
            np.matmul(p, ones, out=sums[:, :, h])
            met.append(p)
            values.append(v)
        sums += sums.dtype.type(1e-20)
        by_head = mean.reshape(*own.shape, HEADS, PART)
        by_head /= sums
        return own, pair, met, sums, values, mean

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        """Hidden rows of the last STEP places of windows x, with a one behind."""
        own, *_, mean = self._attend(x.astype(np.intp), self.scoring)
        mean += np.take(self.w["own"], own, axis=0)
        _squash(mean)
        hidden = np.ones((own.size, WIDTH + 1), mean.dtype)
        hidden[:, :WIDTH] = mean.reshape(-1, WIDTH)
        return hidden

    def score(self, x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each goal class (PAD: 0), and that of any class which begins a word."""
        hidden = self._hidden(x)
        logits = hidden @ self.w["group"]
        real, of, within, ends = _by_group(goal)
        e, total = _shares(logits)
        begin = np.log(e[:, :BEGIN_GROUPS] @ np.ones((BEGIN_GROUPS, 1), e.dtype) + e.dtype.type(1e-30))[:, 0] - total
        rows, picked = np.take(hidden, real, axis=0), logits[real, of] - total[real]
        for k in range(GROUPS):
            if (a := ends[k]) < (b := ends[k + 1]):
                logits = rows[a:b] @ self.w["member"][k]
                _, total = _shares(logits)
                picked[a:b] += logits[np.arange(b - a), within[a:b]] - total
        out = np.zeros(goal.size, picked.dtype)
        out[real] = picked
        return out, begin

    def gradient(self, x: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability of the goals, in one row like the weights."""
        w = self.w
        flat = np.zeros(_SIZE, self.flat.dtype)
        out = _named(flat)
        ids, x = x, x.astype(np.intp)
        own, pair, met, sums, values, mean = self._attend(x, self.tables())
        hidden = np.take(w["own"], own, axis=0)
        hidden += mean
        _squash(hidden)
        real, of, within, ends = _by_group(goal)
        rows = np.ones((len(real), WIDTH + 1), hidden.dtype)
        rows[:, :WIDTH] = np.take(hidden.reshape(-1, WIDTH), real, axis=0)
        at, n = np.arange(len(real)), flat.dtype.type(max(1, len(real)))

        def error(logits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            e, total = _shares(logits)
            e *= (np.exp(-total) / n)[:, None]
            e[at[: len(e)], wanted] -= 1.0 / n
            return e

        d = error(rows @ w["group"], of)
        out["group"][:] = rows.T @ d
        back = d @ w["group"][:WIDTH].T
        for k in range(GROUPS):
            if (a := ends[k]) < (b := ends[k + 1]):
                d = error(rows[a:b] @ w["member"][k], within[a:b])
                out["member"][k] = rows[a:b].T @ d
                back[a:b] += d @ w["member"][k, :WIDTH].T
        slope = 1.0 - np.abs(rows[:, :WIDTH])
        back *= slope
        back *= slope
        inner = np.zeros((own.size, WIDTH), hidden.dtype)
        inner[real] = back

        out["own"][:] = _summed(ids[:, WINDOW - STEP :], inner)
        inner = inner.reshape(*own.shape, HEADS, PART)
        inner /= sums
        moved = np.einsum("bihk,bihk->bih", inner, mean.reshape(inner.shape))[..., None]
        grown = np.empty((*x.shape, WIDTH), hidden.dtype)
        for h, (p, v) in enumerate(zip(met, values)):
            d = inner[:, :, h]
            np.matmul(p.transpose(0, 2, 1), d, out=grown[:, :, h * PART : (h + 1) * PART])
            s = d @ v.transpose(0, 2, 1)
            s -= moved[:, :, h]
            s *= p
            total = np.bincount(pair.ravel(), s.ravel(), SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS).astype(flat.dtype)
            out["query"][h], out["key"][h] = total @ w["key"][h], total.T @ w["query"][h]
            out["place"][h] = np.bincount(np.maximum(_BEHIND, 0).ravel(), np.where(_BEHIND >= 0, s.sum(0), 0.0).ravel(), WINDOW)
        out["value"][:] = _summed(ids, grown.reshape(-1, WIDTH)).reshape(SYMBOLS, HEADS, PART).transpose(1, 0, 2)
        return flat

    def train(self, x: np.ndarray, goal: np.ndarray, rate: float, moments: tuple | None = None) -> tuple:
        """One pass of Adam over windows in their order; moments: what an earlier call returned, which this one goes on from."""
        first, second, step = moments or (np.zeros_like(self.flat), np.zeros_like(self.flat), 0)
        for at in range(0, len(x), BATCH):
            step += 1
            g = self.gradient(x[at : at + BATCH], goal[at : at + BATCH])
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            self.flat -= rate / (1 - 0.9**step) * first / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        return first, second, step


@dataclass
class Model:
    classes: Classes
    attention: Attention

    def words(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of each word and each end, in order; ids: the subwords of all texts in a row, each with its
        end; sizes: how many a text has."""
        ends = np.cumsum(sizes)
        row, starts, goal, _ = inputs_and_starts(np.split(self.classes.of[ids], ends[:-1]))
        own, begin = np.zeros(goal.shape), np.zeros(goal.shape)
        for at in range(0, len(starts), PHASE):
            x = row[starts[at : at + PHASE, None] + np.arange(WINDOW)]
            got = self.attention.score(x, goal[at : at + PHASE])
            own[at : at + PHASE], begin[at : at + PHASE] = (y.reshape(len(x), STEP) for y in got)
        real = goal != PAD
        own, begin = own[real] + self.classes.within[ids], begin[real]
        first = begins_word(self.classes.of[ids])
        word = np.cumsum(first) - 1
        out = np.bincount(word, own)
        moved = first.copy()
        moved[ends[:-1]] = False  # the first subword of a text ends no word
        moved[0] = False
        out[word[moved]] -= begin[moved]
        np.add.at(out, word[moved] - 1, begin[moved])
        return out


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_ID = np.dtype("<u2")


def _packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The rows of ids up to each of ends, two bytes an id."""
    offsets = np.append(0, ends) * _ID.itemsize
    buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(_ID).tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), buffers).cast(pa.binary())


def cut_texts(docs: DataFrame, subwords: Subwords) -> DataFrame:
    """Of each row of docs (key, text): row, key, held_out, words and ids (its subwords, packed, without the end); and beside
    them, of each task, word (packed ids; empty: the end of a text) and n, how often training rows have it."""
    shared = docs.sparkSession.sparkContext.broadcast(subwords.pieces)
    kind = docs.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        memory, tally, known = Memory(Subwords(shared.value)), np.zeros(0, np.int64), 0
        blank = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
        key_kind = None

        def counted() -> pa.RecordBatch:
            met = np.flatnonzero(tally)
            ids, sizes = memory.subwords_of(met)
            words = pa.concat_arrays([_packed(ids, np.cumsum(sizes)), pa.array([b""], pa.binary())])
            n = pa.array(np.append(tally[met], known), pa.int64())
            return _batch(dict(zip(("row", "key", "held_out", "words", "ids", "word", "n"), [*blank(len(n), pa.int64(), key_kind, pa.bool_(), pa.int64(), pa.binary()), words, n])))

        for batch in batches:
            key_kind = batch.schema.field("key").type
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                if len(memory.number) > REMEMBERED:
                    yield counted()
                    memory.clear()
                    tally, known = np.zeros(0, np.int64), 0
                line, starts, ends, n = split_texts(part.column("text").to_pylist())
                learned = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                _, first, back = np.unique(names_of(np.frombuffer(line, np.uint8), starts, _LETTER), return_index=True, return_inverse=True)
                numbers = memory.numbers([line[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])[back]
                ids, sizes = memory.subwords_of(numbers)
                tally = np.append(tally, np.zeros(len(memory.number) - len(tally), np.int64))
                tally += np.bincount(numbers[np.repeat(learned, n)], minlength=len(tally))
                known += int(learned.sum())
                found = [part.column(c) for c in ("row", "key", "held_out")] + [pa.array(n, pa.int64()), _packed(ids, np.append(0, np.cumsum(sizes))[np.cumsum(n)])]
                yield _batch(dict(zip(("row", "key", "held_out", "words", "ids", "word", "n"), [*found, *blank(len(part), pa.binary(), pa.int64())])))
        if key_kind is not None:
            yield counted()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "key", is_held_out(F.col("key")).alias("held_out"), "text")
    return rows.mapInArrow(cut, f"row long, key {kind}, held_out boolean, words long, ids binary, word binary, n long")


def count_subwords(counts: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each subword occurs in words (packed ids) that occur n times; the driver gets one row for each, at most the vocabulary."""
    end = subwords.end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.array([len(w) // _ID.itemsize for w in words], np.int64)
            total += np.bincount(np.frombuffer(b"".join(words), _ID), np.repeat(n, sizes), end + 1)
            total[end] += n[sizes == 0].sum()
        at = np.flatnonzero(total)
        yield _batch({"id": pa.array(at, pa.int64()), "n": pa.array(total[at].astype(np.int64), pa.int64())})

    rows = counts.select("word", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(end + 1)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


_FIXED = float(1 << 30)  # weights are summed as whole multiples of its inverse, so their order does not count


def train(texts: DataFrame, classes: Classes, words: int) -> Attention:
    """Attention fitted on texts (key, ids), each met once; words: how many they have."""
    shared = texts.sparkSession.sparkContext.broadcast(classes.of)
    folds = max(1, words // (ROUNDS * FOLD_WORDS))
    drawn = F.xxhash64(F.col("key").cast("string"), "ids")
    dealt = texts.select("ids", drawn.alias("drawn")).withColumn("fold", F.pmod(F.shiftright("drawn", 8), F.lit(folds)).cast("int"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            found = [of[np.frombuffer(x.as_buffer(), _ID)].tobytes() + of[-1:].tobytes() for x in batch.column("ids")]
            yield _batch({"fold": batch.column("fold"), "drawn": batch.column("drawn"), "classes": pa.array(found, pa.binary())})

    model = Attention.initial(classes.share)
    for r in range(ROUNDS):
        start, rate = model.flat, 0.02 / (1 + 2 * r)

        def local(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, rate: float = rate) -> Iterator[pa.RecordBatch]:
            # a task holds the windows of MIXED documents
            keep_freed()
            total, trained, now = np.zeros(_SIZE, np.int64), 0, None
            waiting: list[np.ndarray] = []

            def learn() -> None:
                nonlocal moments
                row, starts, goal, _ = inputs_and_starts(waiting)
                mixed = mixer.permutation(len(starts))
                for part in np.split(mixed, range(64 * BATCH, len(mixed), 64 * BATCH)):
                    moments = own.train(row[starts[part, None] + np.arange(WINDOW)], goal[part], rate, moments)
                waiting.clear()

            def done() -> None:
                nonlocal trained
                if now is not None:
                    if waiting:
                        learn()
                    total[:] += np.rint(own.flat * _FIXED).astype(np.int64)
                    trained += 1

            for batch in batches:
                for fold, packed in zip(batch.column("fold").to_pylist(), batch.column("classes")):
                    if fold != now:
                        done()
                        now, own, moments, mixer = fold, Attention(start.copy()), None, np.random.default_rng(0)
                    waiting.append(np.frombuffer(packed.as_buffer(), np.uint8))
                    if len(waiting) == MIXED:
                        learn()
            done()
            if trained:
                yield _batch({"total": pa.array([total], pa.list_(pa.int64())), "trained": pa.array([trained], pa.int64())})

        mine = dealt.where(F.pmod("drawn", F.lit(ROUNDS)) == r).mapInArrow(classed, "fold int, drawn long, classes binary")
        ordered = mine.repartitionById(folds, "fold").sortWithinPartitions("fold", "drawn", "classes")
        sums = ordered.select("fold", "classes").mapInArrow(local, "total array<long>, trained long")
        found = sums.select("trained", F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("total"), F.sum("trained").alias("trained")).toPandas()
        if len(found):
            flat = np.zeros(_SIZE, np.float32)
            flat[found["pos"].to_numpy()] = found["total"].to_numpy() / _FIXED / found["trained"].to_numpy()
            model = Attention(flat)
    return model


def frequent_words(counts: DataFrame, limit: int = FREQUENT) -> tuple[dict[bytes, int], int]:
    """The words counted at least some number of times, at most limit of them, and that number; found by a histogram of
    a few hundred rows, so no task gathers the words."""
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    held, least = 0, None
    for row in counts.groupBy(level).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        held += row.k
        if held > limit:
            break
        least = row.n
    if least is None:
        return {}, 1 << 62
    found = counts.where(F.col("n") >= least).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist())), least


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Null and empty texts are one token, the end. Repeated rows are scored (and learned from) each by itself; a null id
    counts as an empty one. Without training documents nothing is known: base_score is then the sum of log10(1 / (N + V + 1))
    with N = V = 0, and the model that of untrained classes. An empty table gives an empty result; texts are scored whole,
    however long; other columns are not looked at.
    """
    spark, early, tables = docs.sparkSession, Tables(docs.sparkSession), Tables(docs.sparkSession)
    subwords = Subwords.load(vocabulary)
    cut = early.write(cut_texts(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), subwords))
    texts = cut.where("row is not null").drop("word", "n")
    counts = tables.write(cut.where("n > 0").select("word", "n").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent, least = frequent_words(counts)
    begins = np.append(subwords.begins, True)
    classes = Classes.from_counts(count_subwords(counts, subwords), begins)
    attention = train(texts.where("not held_out"), classes, total)
    often = np.frombuffer(b"".join(w for w in frequent if w), _ID)
    names, at = np.unique(names_of(often, np.flatnonzero(begins[often])), return_index=True)
    shared = spark.sparkContext.broadcast((begins, classes, attention.flat, names, np.array([n for w, n in frequent.items() if w], np.int64)[at]))
    n_end = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        begins, classes, weights, names, times = shared.value
        model, end = Model(classes, Attention(weights)), len(begins) - 1
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                packed, n = part.column("ids").to_pylist(), part.column("words").to_numpy()
                sizes = np.array([len(x) // _ID.itemsize for x in packed], np.int64)
                ids = np.insert(np.frombuffer(b"".join(packed), _ID), np.cumsum(sizes), end)  # the end of each text behind its words
                logs = model.words(ids, sizes + 1)
                first = np.flatnonzero(begins[ids])
                own = names_of(ids, first)
                at_name = np.minimum(np.searchsorted(names, own), max(0, len(names) - 1))
                count = np.where(names[at_name] == own, times[at_name], -1) if len(names) else np.full(len(own), -1)
                ends = np.cumsum(n + 1) - 1
                count[ends] = n_end
                text = np.repeat(np.arange(len(n)), n + 1)
                rare = count < 0
                mixed = np.where(count <= 0, logs + MIX, np.logaddexp(logs + MIX, np.log(np.maximum(count, 1) / max(1, total)) + MIX)) / math.log(10)
                offsets = np.append(0, np.cumsum(np.bincount(text[rare], minlength=len(n)))).astype(np.int32)
                line, places = ids.tobytes(), np.append(first, len(ids)) * _ID.itemsize
                words = [line[a:b] for a, b in zip(places[:-1][rare].tolist(), places[1:][rare].tolist())]
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words, pa.binary()))
                spelled = pa.ListArray.from_arrays(pa.array(offsets), pa.array(mixed[rare], pa.float32()))
                sums = np.bincount(text, np.where(rare, 0.0, np.log10(np.maximum(count, 0) + 1.0)), len(n))
                met = np.bincount(text, count > 0, len(n)).astype(np.int64)
                kept = {c: part.column(c) for c in ("row", "key", "held_out")}
                yield _batch(kept | {"n": pa.array(n + 1, pa.int64()), "sums": pa.array(sums), "met": pa.array(met), "score": pa.array(np.bincount(text, mixed, len(n))), "rest": rest, "spelled": spelled})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    scored = tables.write(texts.mapInArrow(score, f"row long, key {kind}, held_out boolean, n long, sums double, met long, score double, rest array<binary>, spelled array<float>"))
    early.clear()
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "spelled")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.spelled").cast("double").alias("spelled"))
    joined = rare.join(counts.where((F.col("n") < least) & (F.octet_length("word") > 0)), "word")
    # log10 of one share more: log10(10**a + 10**b) - a
    apart = F.log10(F.col("n") / F.lit(float(max(1, total)))) + F.lit(MIX / math.log(10)) - F.col("spelled")
    gain = F.greatest(apart, F.lit(0.0)) + F.log10(1.0 + F.pow(F.lit(10.0), -F.abs(apart)))
    more = joined.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("also"), F.sum(gain).alias("gain"))
    out = scored.drop("rest", "spelled").join(more, "row", "left")
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n") * F.lit(math.log10(total + kinds + 1))
    return out.select(F.col("key").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("met") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
