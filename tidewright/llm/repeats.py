"""Removal of long passages that occur elsewhere, by a run-length index.

Two equal strings of WINDOW bytes must meet before they can be compared. Each window of a text is named by the least hash
of the byte strings of SEEDS[0] length inside it; neighbouring windows of one name are one piece of the text. Equal windows
have equal names, so pieces of one name form a bucket, and a bucket decides about all its windows. Names that only one piece
has are dropped before any text moves; equal pieces of a bucket are one row.

Buckets are packed into blocks of text. A block's Burrows-Wheeler transform is kept as runs of equal characters with, at
the ends of each run, the text positions of the two suffixes that meet there and how long they agree. Inside a run the agreement of
a suffix with its neighbour falls by one from a place of the text to the next, so those samples, streamed in text order, give the
matching statistics: at each place the length of the longest string that also starts elsewhere. Places with WINDOW or
more start a repeated string.

A bucket of more than HOT distinct pieces (a short passage in many contexts) is not indexed whole: its pieces are treated as
texts and cut again by the next longer seed, which tells more contexts apart. With the last seed, as long as a window, a
piece is one window and a bucket one distinct piece, so no bucket is too large for a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import Tables

#: Bytes of a string that counts as repeated.
WINDOW = 200
#: Lengths of the strings that name windows, by level.
SEEDS = (64, 136, WINDOW)
#: Distinct pieces of a bucket that is indexed whole.
HOT = 4_000
#: Bytes of text that are indexed at once.
BLOCK = 1_500_000
#: Windows of a text that are named at once.
CHUNK = 1 << 21
#: Bits of the table that says which texts need no look.
SIEVE = 1 << 25

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPANS = "array<struct<start:long,end:long>>"
_PIECE = "key long, name binary, t binary, start long, n long, piece binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + WINDOW), _powers(pow(_BASE, -1, 1 << 64), CHUNK + WINDOW)


def hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each string of k bytes of text (at most CHUNK + WINDOW bytes)."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_UP[:n] * (text.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _DOWN[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ h >> np.uint64(32)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each stretch of width values, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = pick(values[:-done], values[done:]), 2 * done
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def pieces_of(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first window, number of windows, and whether its name has several places in the text, of each piece."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    whole, width = np.frombuffer(text, np.uint8), WINDOW - k + 1
    for at in range(0, len(whole) - WINDOW + 1, CHUNK):
        h = hashes(whole[at : at + CHUNK + WINDOW - 1], k)
        least = _sliding(h, width, np.minimum)
        begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        names, lengths = least[begins], np.diff(begins, append=len(least))
        # a piece has width windows at most: a longer run has its name at several places
        parts = -(-lengths // width)
        order = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        names, begins, lengths = np.repeat(names, parts), np.repeat(begins, parts) + order * width, np.repeat(lengths, parts)
        lengths = np.minimum(width, lengths - order * width)
        edge = np.zeros(width - 1, np.uint64)
        chosen = h[_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h]  # the names, at all their places
        values, places = np.unique(chosen, return_counts=True)
        for column, found in zip(out, (names.view(np.int64), begins + at, lengths, np.isin(names, values[places > 1]))):
            column.append(found)
    empty = (np.int64, np.int64, np.int64, bool)
    return tuple(np.concatenate(c) if c else np.zeros(0, d) for c, d in zip(out, empty))


def _suffix_order(symbols: np.ndarray, ends: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of pieces (symbols from 1, each piece closed by a 0 at its place in ends), and 7 symbols from each place.

    Closing signs are less than all others and among themselves in the order of pieces. Orders of h symbols give that of 2h;
    only suffixes that are still tied are sorted again.
    """
    n = len(symbols)
    packed, alive = symbols.astype(np.int64), symbols > 0
    for j in range(1, 7):
        ahead = np.zeros(n, np.int64)
        ahead[: n - j] = symbols[j:]
        ahead[~alive] = 0
        packed = packed << 9 | ahead
        alive = alive & (ahead > 0)
    places = np.flatnonzero(symbols)
    order = places[np.argsort(packed[places], kind="stable")]
    rank = np.zeros(n, np.int64)
    rank[symbols == 0] = np.arange(count)
    slots = np.arange(len(order))

    def settle(own: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks suffixes own (in order, at slots at) by keys; those that are still tied, and their slots."""
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[own] = count + at[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]
        tied = ~(head & np.concatenate([head[1:], [True]]))
        return own[tied], at[tied]

    tied, at = settle(order, slots, packed[order]) if len(order) else (order, slots)
    h = 7
    while len(tied):
        keys = rank[tied] * (n + count + 1) + rank[np.minimum(tied + h, ends[tied])]
        by = np.argsort(keys, kind="stable")
        order[at] = tied = tied[by]
        tied, at = settle(tied, at, keys[by])
        h *= 2
    return order, packed


class RunIndex:
    """The run-compressed transform of some pieces of text, with the text places and agreements at the ends of its runs."""

    def __init__(self, pieces: Sequence[bytes]):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        self.stops = np.cumsum(sizes) - 1
        symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 1
        symbols[self.stops] = 0
        self.starts, self.size = self.stops - sizes + 1, len(symbols)
        order, packed = _suffix_order(symbols, np.repeat(self.stops, sizes), len(pieces))
        before = symbols[order - 1]  # in front of a piece stands the sign that closes another: like none but itself
        border = np.ones(len(order), bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(border)
        #: the runs: their character, and the suffixes at each border with the length on which they agree
        self.characters, self.lengths = before[heads], np.diff(heads, append=len(order))
        self.below, self.above = order[heads[1:]], order[heads[1:] - 1]
        self.first, self.last = order[:1], order[-1:]  # these have no neighbour in front and behind
        self.agree = self._agreement(symbols, packed)

    def _agreement(self, symbols: np.ndarray, packed: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(self.below), np.int64), np.arange(len(self.below))
        while len(open_):  # seven symbols at a time, as long as no piece ends
            x = packed[self.below[open_] + out[open_]]
            open_ = open_[(x == packed[self.above[open_] + out[open_]]) & (x & 511 > 0)]
            out[open_] += 7
        open_ = np.arange(len(out))
        while len(open_):
            x = symbols[self.below[open_] + out[open_]]
            open_ = open_[(x == symbols[self.above[open_] + out[open_]]) & (x > 0)]
            out[open_] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """At each place of the text the length of the longest string that also starts at another one."""
        out, places = np.zeros(self.size, np.int64), np.arange(self.size)
        for ends, alone in ((self.below, self.first), (self.above, self.last)):
            sampled = np.full(self.size, -1, np.int64)
            sampled[alone] = 0
            sampled[ends] = self.agree
            last = np.maximum.accumulate(np.where(sampled >= 0, places, -1))
            out = np.maximum(out, np.where(last >= 0, sampled[last] - (places - last), 0))
        return out


def repeated_windows(pieces: Sequence[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each piece, which of its windows also start elsewhere in the pieces."""
    index = RunIndex(pieces)
    repeated = index.matching_statistics() >= window
    return [repeated[a : max(a, z - window + 1)] for a, z in zip(index.starts.tolist(), index.stops.tolist())]


def _ranges(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False)).tolist()
    return [{"start": a, "end": z} for a, z in zip(edges[::2], edges[1::2])]


def _name_windows(level: int):
    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40  # texts are numbered by task and place; the numbers are written with the names
        for frame in frames:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            digests = []
            for t, text in zip(frame["t"], frame["text"]):
                names, starts, counts, again = pieces_of(text, SEEDS[level])
                values, places = np.unique(names, return_counts=True)
                again |= np.isin(names, values[places > 1])
                same = np.ones(len(names), np.int64)
                for column, found in zip(columns, (same * number, same * int.from_bytes(t[:8], "little", signed=True), names, starts, counts, again)):
                    column.append(found)
                digests += [t, *[None] * (len(names) - 1)]
                number += 1
            out = {c: np.concatenate(x) if x else [] for c, x in zip(("no", "tag", "key", "start", "n", "again"), columns)}
            yield pd.DataFrame(out | {"t": pd.Series(digests, dtype=object)})

    return name


def sieve(members: DataFrame, texts: DataFrame) -> DataFrame:
    """texts with may: false where t is in no row of members for sure.

    A table of SIEVE bits, in words of 64, is broadcast: its size is fixed, so with very many members it lets more through, and only
    the work behind it grows.
    """
    bit = F.pmod(F.xxhash64("t"), F.lit(SIEVE))
    word, place = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    words = members.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = texts.withColumn("word", word).join(F.broadcast(words), "word", "left")
    may = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), place) == 1
    return found.withColumn("may", may).drop("word", "bits")


def _cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of each text, copies of a text once in a task."""
    seen: set[bytes] = set()
    for frame in frames:
        out = []
        for t, text, wanted in zip(frame["t"], frame["text"], frame["wanted"]):
            if t not in seen:
                seen.add(t)
                for w in wanted:
                    piece = text[w["start"] : w["start"] + w["n"] + WINDOW - 1]
                    out.append((w["key"], hashlib.blake2b(piece, digest_size=16).digest(), t, w["start"], w["n"], piece))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which windows of each piece are repeated; blocks of whole buckets are indexed one after another."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pd.DataFrame:
        flags = repeated_windows([p for *_, p in held])
        return pd.DataFrame([(key, name, _ranges(np.ones(len(f), bool) if many else f)) for (key, name, many, _), f in zip(held, flags)], columns=["key", "name", "ranges"])

    for frame in frames:
        for row in zip(frame["key"], frame["name"], frame["many"], frame["piece"]):
            if size >= BLOCK and row[0] != last:
                yield flush()
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[3]), row[0]
    if held:
        yield flush()


def repeated_ranges(texts: DataFrame, tables: Tables, level: int = 0) -> DataFrame:
    """t and ranges of first bytes of windows that also start in another text or place, for each text that has some.

    texts: t (a digest of the text) and text (binary); copies of a text are one text here.
    """
    spark = texts.sparkSession
    named = tables.write(texts.where(F.octet_length("text") >= WINDOW).mapInPandas(_name_windows(level), "no long, tag long, key long, start long, n long, again boolean, t binary"))
    # names in several texts (copies are one), or at several places of one
    shared = tables.write(named.groupBy("key").agg(F.min("tag").alias("low"), F.max("tag").alias("high"), F.max("again").alias("again")).where("low <> high or again").select("key"))
    owners = named.where("t is not null").groupBy("t").agg(F.min("no").alias("no"))
    by_text = named.select("no", "key", "start", "n").join(shared, "key", "left_semi").groupBy("no").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))
    wanted = tables.write(by_text.join(owners, "no").select("t", "wanted"))
    pieces = tables.write(sieve(wanted, texts).where("may").join(wanted, "t").select("t", "text", "wanted").mapInPandas(_cut_out, _PIECE))
    distinct = tables.write(pieces.groupBy("key", "name").agg(F.first("piece").alias("piece"), F.first("n").alias("n"), (F.count(F.lit(1)) > 1).alias("many")))
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("pieces"), F.min("many").alias("all_many"))
    hot = spark.createDataFrame([], "key long")
    if level + 1 < len(SEEDS):
        hot = tables.write(sizes.where(F.col("pieces") > HOT).select("key"))
    # a bucket of one piece that has several places needs no index
    open_ = distinct.join(sizes.where("pieces > 1 or not all_many").select("key"), "key", "left_semi").join(hot, "key", "left_anti")
    indexed = open_.select("key", "name", "many", "piece").repartition("key").sortWithinPartitions("key").mapInPandas(_index, f"key long, name binary, ranges {_SPANS}").where(F.size("ranges") > 0)
    whole = lambda df: df.where("many").select("key", "name", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).alias("ranges"))
    marks = indexed.unionByName(whole(distinct.join(sizes.where("pieces = 1 and all_many").select("key"), "key", "left_semi")))
    if level + 1 < len(SEEDS) and not hot.isEmpty():
        again = distinct.join(hot, "key", "left_semi")
        deeper = repeated_ranges(again.select(F.col("name").alias("t"), F.col("piece").alias("text")), tables, level + 1)
        found = again.where("not many").join(deeper.withColumnRenamed("t", "name"), "name").select("key", "name", "ranges")
        marks = marks.unionByName(found).unionByName(whole(again))
    located = pieces.select("t", "start", "key", "name").join(marks, ["key", "name"])
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), (r["end"] + F.col("start")).alias("end")))
    return tables.write(located.select("t", moved.alias("ranges")).groupBy("t").agg(F.flatten(F.collect_set("ranges")).alias("ranges")))


_CUT = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def cut(text: bytes, ranges: Sequence[tuple[int, int]]) -> tuple[list[dict[str, int]], bytes]:
    """The maximal spans of bytes that windows starting in ranges cover, and the rest of text."""
    spans: list[dict[str, int]] = []
    for start, end in sorted(ranges):
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], end - 1 + WINDOW)
        else:
            spans.append({"start": start, "end": end - 1 + WINDOW})
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return spans, b"".join([*kept, text[at:]])


@F.pandas_udf(_CUT)
def _cut(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    none: list = []
    return pd.DataFrame([cut(t, none if r is None else [(x["start"], x["end"]) for x in r]) for t, r in zip(text, ranges)], columns=_CUT.names)


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (start and end of each maximal removed run of bytes) and kept (the bytes left) for every row of docs.

    Removed is each byte that a string of WINDOW bytes covers which also starts elsewhere: in another row, be it a copy,
    or at another place of the same text, overlapping or not. Strings are those of the input, not of what is left.

    Null and empty texts have no bytes; texts under WINDOW bytes lose none. Ids are not looked at: null and repeated ones are rows of
    their own, and rows alike in all columns are copies of each other. An empty table gives none. Other columns are not read.
    kept may begin or end inside a character, as spans do.
    """
    scratch, tables = Tables(docs.sparkSession), Tables(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), _bytes(F.col(text_col)).alias("text")).withColumn("t", F.unhex(F.md5("text")))
    ranges = repeated_ranges(texts.select("t", "text"), scratch)
    copies = texts.where(F.octet_length("text") >= WINDOW).groupBy("t").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).cast("long").alias("n")).where("rows > 1")
    whole = copies.select("t", F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("n") - WINDOW + 1).alias("end"))).alias("whole"))
    found = tables.write(ranges.join(whole, "t", "full_outer").select("t", F.coalesce("whole", "ranges").alias("ranges")))
    scratch.clear()
    sieved = sieve(found, texts)
    touched = sieved.where("may").join(found, "t", "left").select("id", "text", _cut("text", "ranges").alias("c")).select("id", "text", "c.spans", "c.kept")
    whole = sieved.where("not may").select("id", "text", F.array().cast(_SPANS).alias("spans"), F.col("text").alias("kept"))
    return touched.unionByName(whole).select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "spans", "kept")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of remove_repeats."""
    return remove_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of repeat_digests: all windows by their digest, their islands, and the text between, two hexadecimal digits a byte."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    windows AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * WINDOW})) AS m FROM (SELECT r, h, unnest(range(0, greatest(n - {WINDOW - 1}, 0))) AS i FROM d)),
    repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM windows) WHERE c > 1),
    islands AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS new FROM repeated)),
    spans AS (SELECT r, min(i) AS a, max(i) + {WINDOW} AS z FROM islands GROUP BY r, k),
    gaps AS (SELECT r, z AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1::BIGINT << 40) AS z FROM (SELECT r, a, z FROM spans UNION ALL SELECT r, -1, 0 FROM d)),
    kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (least(z, n) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (r) WHERE a < n GROUP BY r)
    SELECT doc_id, n AS n_bytes, n - strlen(coalesce(k, '')) // 2 AS n_removed, (SELECT count(*) FROM spans s WHERE s.r = d.r) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
