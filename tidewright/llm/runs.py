"""Periodic runs of words by an all-lag scan.

The words of a text become an array of word ids, which is compared with itself shifted by every lag q up to n/4; a
stretch of max(6 - q, 3q) equal places or more is a run of period q. Texts of up to LAGS lags are laid end to end (no
two share an id, so nothing matches across them) and one comparison serves all that are long enough for a lag. Longer
ones are dealt out over the cluster as ranges of LAGS lags, each with the word ids, so the work a range costs grows with
what it carries; their runs meet again by text.

A stretch found at lag q is found at the multiples of q that fit it four times, with the same ends; the least lag stays,
which is the smallest period: a stretch of length 4q or more with a smaller period p has p + q within it, so gcd(p, q) is
a period too and its own scan finds the same stretch.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Tables, crc32_sql

#: A run has this many words and this many times its period at least.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Lags of a range: texts with more of them are split.
LAGS = 2_500
#: Words that are compared at once.
BATCH = 300_000

Run = tuple[int, int, int]

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_UNIT = "part string, low long, high long, ids binary, words binary"


def lags_of(n: int) -> int:
    """The greatest lag at which n words can hold a run."""
    return n // MIN_EXPONENT if n >= MIN_LENGTH else 0


def planted(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """words, with a periodic end where the checksum of the decimal id (none: no checksum) says so."""
    if doc_id is None or not words or (h := zlib.crc32(doc_id.encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def word_ids(words: Sequence[bytes], first: int = 0) -> np.ndarray:
    """Numbers from first on that are alike where words are."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)) + np.int32(first)


def stretches(ids: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """Start and length of all maximal stretches of period lag that are long enough for a run."""
    same = ids[lag:] == ids[:-lag]
    least = max(MIN_LENGTH - lag, (MIN_EXPONENT - 1) * lag)
    # places with 2, 4 and 8 equal ones ahead: most lags end here
    some, width = same, 1
    while width < 8 and 2 * width <= least:
        some = some[:-width] & some[width:]
        width *= 2
    if not some.any():
        return []
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    keep = ends - begins >= least
    return list(zip(begins[keep].tolist(), (ends - begins + lag)[keep].tolist()))


def primitive(found: dict[tuple[int, int], int]) -> list[Run]:
    """Runs by start, then period, from the least lag of each stretch."""
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of_many(texts: Sequence[Sequence[bytes]]) -> list[list[Run]]:
    """The runs of each text; all texts are compared at once, the longest first so that those of a lag are a prefix."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = [len(texts[k]) for k in order]
    begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    parts, first = [], 0
    for k in order:
        parts.append(word_ids(texts[k], first))
        first += len(texts[k])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    long_enough = len(sizes)
    for lag in range(1, lags_of(sizes[0] if sizes else 0) + 1):
        while sizes[long_enough - 1] < max(MIN_LENGTH, MIN_EXPONENT * lag):
            long_enough -= 1
        for start, length in stretches(ids[: begins[long_enough]], lag):
            at = int(np.searchsorted(begins, start, "right")) - 1
            found[order[at]].setdefault((start - int(begins[at]), length), lag)
    return [primitive(f) for f in found]


def described(words: Sequence[bytes], runs: Sequence[Run]) -> tuple:
    """The columns of RESULT."""
    dropped = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = [w for w, d in zip(words, np.cumsum(dropped[:-1]).tolist()) if not d]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(names), dtype=object)


_NAMES = ["doc_id", *(c.split()[0] for c in RESULT.split(", ")), *(c.split()[0] for c in _UNIT.split(", "))]


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of texts of one range; of the others a row for each range, and one with the words."""
    none, blank = (None,) * 5, (None,) * 7
    for frame in frames:
        ids, texts, held, out = [], [], 0, []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            words = planted((text or b"").split(), doc_id)  # bytes split at the six white-space characters of the contract
            last = lags_of(len(words))
            if last > LAGS:
                part, numbers = uuid.uuid4().hex, word_ids(words).tobytes()
                out.append((doc_id, *blank, part, None, None, None, b" ".join(words)))
                out += [(doc_id, *blank, part, low, min(low + LAGS, last + 1), numbers, None) for low in range(1, last + 1, LAGS)]
                continue
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
            if held >= BATCH:
                out += [(i, *described(w, r), *none) for i, w, r in zip(ids, texts, runs_of_many(texts))]
                ids, texts, held = [], [], 0
        out += [(i, *described(w, r), *none) for i, w, r in zip(ids, texts, runs_of_many(texts))]
        yield _frame(out, _NAMES)


def _scan_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of each range of lags."""
    for frame in frames:
        for part, low, high, numbers in zip(frame["part"], frame["low"], frame["high"], frame["ids"]):
            ids = np.frombuffer(numbers, np.int32)
            found = [(part, s, n, lag) for lag in range(int(low), int(high)) for s, n in stretches(ids, lag)]
            yield pd.DataFrame(found, columns=["part", "start", "length", "period"])


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc_id, words, runs in zip(frame["doc_id"], frame["words"], frame["runs"]):
            found = [] if runs is None else primitive({(r["start"], r["length"]): r["period"] for r in runs})
            out.append((doc_id, *described(words.split(b" "), found)))
        yield _frame(out, _NAMES[:8])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the text without their repetitions, for each row.

    Only doc_id and text are read. Null, empty and blank texts have no words and so no runs: n_runs is 0, the run's columns
    are null and the digests are those of nothing. Rows of a null id are taken as they are written (no periodic end);
    repeated rows stay, each with its result. An empty table has no rows. Texts are taken whole, however long.
    """
    # ids travel as text, since pandas makes numbers with nulls inexact
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scanned = Tables(docs.sparkSession).write(source.mapInPandas(_scan, f"doc_id string, {RESULT}, {_UNIT}"))
    ranges = scanned.where("low is not null").select("part", "low", "high", "ids").repartition("part", "low")
    found = ranges.mapInPandas(_scan_ranges, "part string, start long, length long, period long")
    # the least lag of a stretch first: the lists that meet hold no stretch twice
    runs = found.groupBy("part", "start", "length").agg(F.min("period").alias("period")).groupBy("part").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    split = scanned.where("words is not null").select("doc_id", "part", "words").join(runs, "part", "left")
    names = _NAMES[:8]
    out = scanned.where("part is null").select(*names).unionByName(split.select("doc_id", "words", "runs").mapInPandas(_describe, f"doc_id string, {RESULT}"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def oracle_sql() -> str:
    """DuckDB SQL of find_runs: pairs of equal words by their distance, their islands, and the least period of each."""
    return f"""WITH split AS (SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    drawn AS (SELECT *, len(w) AS n, CASE WHEN id IS NOT NULL THEN {crc32_sql('id')} END AS h FROM split),
    placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS parts FROM drawn),
    d AS MATERIALIZED (SELECT r, doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) AS w FROM placed),
    words AS MATERIALIZED (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM d),
    same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // {MIN_EXPONENT}),
    islands AS (SELECT r, q, min(i) AS s, count(*) AS n FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k),
    runs AS MATERIALIZED (SELECT r, s AS start, n + q AS length, min(q) AS period FROM islands WHERE n + q >= greatest({MIN_LENGTH}, {MIN_EXPONENT} * q) GROUP BY 1, 2, 3),
    listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
    longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
    kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM words x WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = x.r AND x.i >= u.start + u.period AND x.i < u.start + u.length) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN listed l USING (r) LEFT JOIN longest USING (r) LEFT JOIN kept k USING (r)"""
