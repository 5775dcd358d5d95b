"""Near-duplicate documents by BagMinHash signatures.

A document is the multiset of its shingles of five normalised words; two documents are linked if
their weighted Jaccard similarity (sum of smaller counts over sum of larger counts) is SIMILARITY or
more. Signatures come from Poisson processes over the weight axis of each shingle, cut into dyadic
blocks [0,1), [1,2), [2,4), ...: a block emits points at its width as rate, each with a place on the
axis and a register; points beyond the shingle's count are thinned away, and a register keeps its
earliest point. So two documents agree in a register with their weighted Jaccard similarity as
probability. Points after the time by which all registers are filled are never made.

Bands of registers give buckets. Copies (equal shingle sequences) share one representative. Pairs are
tried in three rounds, behind each of which the components of the links found so far are known:
1. every representative with its buckets' two pivots (least and greatest number);
2. in buckets that still hold several components, every one with the bucket's hub, that is the member with
   most links, of another component;
3. what is still apart: buckets that share documents form a family, which is dealt into blocks by hash, and
   each pair of blocks is compared in one task. Signatures and weights alone say which documents have a
   partner in a pair of blocks; only the texts of these are read there, and pairs that earlier
   ones already joined are passed over.
Comparison estimates from signatures and confirms on whole texts. No task, group or the driver ever
holds all rows of a bucket, family or component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import NOT_ALNUM, Tables, bounded
from tidewright.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5  # a pair of similarity 0.8 misses all bands with a probability of 3 in 100,000
REGISTERS = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share of registers are not confirmed: four deviations below SIMILARITY,
#: so a pair at it is missed with the same probability of 3 in 100,000.
ESTIMATE = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / REGISTERS)
#: Ids up to so many are broadcast to pick their rows; beyond, rows and ids are dealt out by id.
BROADCAST_IDS = 1_000_000
CHUNK = 2_000_000  # bytes
#: Documents and shingles of a block on average; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 1_000, 400_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_SLACK = 4.0  # beyond the expected time at which all registers are filled


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(256, dtype=_U) * _GOLDEN + _U(1))
_PLACE = _mix(np.arange(1, SHINGLE + 1, dtype=_U) * _GOLDEN) | _U(1)


def normalised(text: Column) -> Column:
    """Lower case words of letters and numbers, joined by one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM, " "))


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each normalised text the 64-bit hashes of its shingles in order; a text of 1 to 4 words is one shingle.

    Texts are taken CHUNK bytes at a time (a longer text alone), so memory follows the longest text, not the batch.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        yield from _shingles(texts.slice(at, to - at))
        at = to


def _shingles(texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
    """shingles of one chunk, from its UTF-8 buffer: a word's hash adds its bytes, mixed and scaled by a power for
    their place in the word; a shingle's adds its words' likewise."""
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + size + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    gap = data == 32
    begin = ~gap
    if len(data):
        inner = offsets[:-1][np.diff(offsets) > 0]  # a text begins a word even behind another text's last
        begin[1:] &= gap[:-1]
        begin[inner] = ~gap[inner]
    starts = np.flatnonzero(begin)
    if len(starts):
        lengths = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data), dtype=np.int64)
        place[starts[0] :] -= np.repeat(starts, lengths)
        powers = np.ones(int(place[starts[0] :].max()) + 1, dtype=_U)
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _GOLDEN, dtype=_U))
        values = _BYTE[data] * powers[np.maximum(place, 0)]
        values[gap] = 0
        words = _mix(np.add.reduceat(values, starts))
    else:
        words = np.zeros(0, _U)
    bounds = np.searchsorted(starts, offsets)
    joined = np.zeros(len(words), _U)
    for k in range(SHINGLE):
        joined[: len(words) - k] += words[k:] * _PLACE[k] if k else words * _PLACE[0]
    joined = _mix(joined)
    for i in range(size):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= SHINGLE:
            yield joined[a : b - SHINGLE + 1]
        elif b > a:
            yield _mix(np.array([np.sum(words[a:b] * _PLACE[: b - a], dtype=_U) + _U(b - a)], dtype=_U))
        else:
            yield words[:0]


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 bits."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(hashes: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The 64-bit ids of the earliest points of the registers, for distinct hashes with counts of 1 or more."""
    total = float(counts.sum())
    horizon = registers * (math.log(registers) + _SLACK) / total
    top = int(counts.max())
    while True:
        times, ids = [], []
        level = 0
        while level == 0 or 1 << (level - 1) < top:
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            mine = counts > low
            seed, most = _mix(hashes[mine] ^ _U((level + 1) * int(_GOLDEN) % (1 << 64))), counts[mine]
            t, step = np.zeros(len(seed)), 1
            block = 1
            while len(seed):
                # the first point of all, then more at once for the few elements that have one in time
                points = _mix(seed[:, None] + np.arange(step, step + block, dtype=_U)[None, :] * _GOLDEN)
                at = t[:, None] - np.cumsum(np.log(_unit(points)), axis=1) / width
                spot = _mix(points ^ _GOLDEN)
                good = (at <= horizon) & (low + np.floor(_unit(spot) * width) < most[:, None])
                times.append(at[good])
                ids.append(spot[good])
                on = at[:, -1] <= horizon
                seed, most, t = seed[on], most[on], at[on, -1]
                step, block = step + block, min(max(4, int(horizon * width) + 4), 1 + (1 << 18) // max(1, len(seed)))
            level += 1
        at, found = np.concatenate(times), np.concatenate(ids)
        out, order = np.zeros(registers, _U), np.argsort(-at, kind="stable")
        where = (_mix(found + _GOLDEN) % _U(registers)).astype(np.int64)
        out[where[order]] = found[order]  # the earliest is written last
        if len(np.unique(where)) == registers:
            return out
        horizon *= 2.0


_MIXERS = _mix(np.arange(1, ROWS + 1, dtype=_U) * _GOLDEN) | _U(1)
_SIGNED = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64())), ("marks", pa.list_(pa.int16()))])
_SIGNED_DDL = "id long, copy long, weight long, bands array<long>, marks array<short>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, copy and text to signatures: the bands' hashes and 16 bits of each register; copies in a batch are signed once."""
    for batch in batches:
        _, first, back = np.unique(batch.column("copy").to_numpy(), return_index=True, return_inverse=True)
        weights, bands, marks = [], [], []
        for h in shingles(batch.column("text").take(pa.array(first))):
            weights.append(len(h))
            if not len(h):
                bands.append([])
                marks.append([])
                continue
            own, counts = np.unique(h, return_counts=True)
            s = signature(own, counts)
            bands.append(_mix((s.reshape(BANDS, ROWS) * _MIXERS).sum(axis=1, dtype=_U)).view(np.int64))
            marks.append((s & _U(0xFFFF)).astype(np.uint16).view(np.int16))
        of = pa.array(back)
        signed = [x.take(of) for x in (pa.array(weights, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int16())))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), *signed], schema=_SIGNED)


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """The weighted Jaccard similarity of two multisets of hashes."""
    if not len(one) or not len(two):
        return 0.0
    a, n = np.unique(one, return_counts=True)
    b, m = np.unique(two, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(one) + len(two) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts to the pairs that are similar enough."""
    for batch in batches:
        found = [similarity(x, y) for x, y in zip(shingles(batch.column("text_a")), shingles(batch.column("text_b")))]
        keep = pa.array([s >= SIMILARITY for s in found], pa.bool_())
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], schema=_LINKED)
        yield out.filter(keep)


def _few(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows."""
    return F.broadcast(df) if bounded(df, limit) else df


def _confirmed(pairs: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """a, b and similarity of the pairs (a < b) that are linked; texts: id, text."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return tables.write(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, similarity double"))


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The distinct pairs (a < b) whose weights and signatures allow SIMILARITY."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: signed.select(F.col("id").alias(n), F.col("weight").alias(f"weight_{n}"), F.col("marks").alias(f"marks_{n}"))
    both = pairs.join(side("a"), "a").where("weight_a is not null").join(side("b"), "b")
    fit = F.least("weight_a", "weight_b") >= SIMILARITY * F.greatest("weight_a", "weight_b")
    same = F.size(F.filter(F.zip_with("marks_a", "marks_b", lambda x, y: x == y), lambda x: x))
    return both.where(fit).where(same >= ESTIMATE * REGISTERS).select("a", "b")


def _candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a pair of blocks, and the rows behind it of another component whose weight and signature allow
    SIMILARITY, the most alike first. Columns block, component, weight and marks; one block is paired with itself."""
    size = table.num_rows
    component, block, weight = (table.column(c).to_numpy() for c in ("component", "block", "weight"))
    marks = table.column("marks").combine_chunks()
    marks = (marks if isinstance(marks, pa.Array) else pa.concat_arrays(marks.chunks)).flatten().to_numpy(zero_copy_only=False).reshape(size, REGISTERS)
    one_block = len(np.unique(block)) < 2
    for i in range(size):
        fit = (np.minimum(weight, weight[i]) >= SIMILARITY * np.maximum(weight, weight[i])) & (component != component[i])
        fit &= (np.arange(size) > i) if one_block else (block > block[i])
        at = np.flatnonzero(fit)
        same = (marks[at] == marks[i]).sum(1)
        enough = same >= ESTIMATE * REGISTERS
        yield i, at[enough][np.argsort(-same[enough], kind="stable")]


_MET_DDL = "family long, x int, y int, id long"


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """The documents of a pair of blocks that have a candidate in it."""
    met = np.zeros(table.num_rows, bool)
    for i, at in _candidates(table):
        met[at] = True
        met[i] |= len(at) > 0
    ids = table.column("id").filter(pa.array(met))
    family, x, y = (pa.array([k.as_py()] * len(ids), kind) for k, kind in zip(key, (pa.int64(), pa.int32(), pa.int32())))
    return pa.table({"family": family, "x": x, "y": y, "id": ids})


def _compare(table: pa.Table) -> pa.Table:
    """Links between documents of a pair of blocks that join all components which its links join."""
    texts = table.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    hashes = [np.unique(h, return_counts=True) for h in shingles(texts)]
    ids, weight, now = table.column("id").to_numpy(), table.column("weight").to_numpy(), table.column("component").to_numpy().copy()
    out: list[tuple[int, int, float]] = []
    for i, at in _candidates(table):
        for j in at:
            if now[i] == now[j]:
                continue
            (a, n), (b, m) = hashes[i], hashes[j]
            k = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int(np.minimum(n, m[k])[b[k] == a].sum())
            found = both / (weight[i] + weight[j] - both)
            if found >= SIMILARITY:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), found))
                now[now == now[j]] = now[i]
    return pa.Table.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(_LINKED.types)], schema=_LINKED)


def _links_of_families(open_rows: DataFrame, signed: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """Links that join the components of open buckets (rows: id, component, and the least id of a bucket) as all links do."""
    family = components(open_rows.select(F.col("id").alias("a"), F.col("low").alias("b")), tables).select(F.col("node").alias("id"), F.col("component").alias("family"))
    docs = tables.write(open_rows.select("id", "component").distinct().join(family, "id").join(signed.select("id", "weight"), "id"))
    need = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("weight") / BLOCK_SHINGLES)
    sizes = docs.groupBy("family").agg(F.ceil(need).cast("int").alias("blocks"))
    dealt = docs.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = dealt.select("id", "component", "family", "block", "weight", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("id", "component", "family", "block", "weight", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    marked = pairs.join(signed.select("id", "marks"), "id")
    met = tables.write(marked.groupBy("family", "x", "y").applyInArrow(_meet, _MET_DDL))
    rows = marked.join(met, ["family", "x", "y", "id"]).join(texts, "id")
    return tables.write(rows.groupBy("family", "x", "y").applyInArrow(_compare, "a long, b long, similarity double"))


def _copy(raw: Column, text: Column) -> Column:
    """The number of a text, which copies share: 64 bits of its digest; texts without a word by their raw form."""
    return F.xxhash64(F.sha2(F.when(text == "", F.concat(F.lit("\u0000"), raw)).otherwise(text), 256))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_class: one row for each row of docs; class_id is the least id of its near-duplicate class.

    Classes are the connected components of copies and links, of rows by their text, whatever their id: rows of a null id, or of equal
    id and other text, are classed like all others. class_id is null if no row of the class has an id. Texts without a word are
    copies only if equal; null counts as empty. Ids are integers. An empty table gives an empty result; other columns are not looked at.
    """
    return _classed(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_class")


def _placed(members: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """The members (id, bucket) of buckets with several components, with the component and the number of links of each."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    placed = members.join(found.join(degree, "node", "left").withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("id", "bucket", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    spread = placed.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("two"), F.max(F.struct("degree", "id")).alias("hub"), F.min("id").alias("low")).where("one < two")
    return placed.join(spread.select("bucket", F.col("hub.id").alias("hub"), "low"), "bucket")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, copy, class (the least copy in it), class_id and n_class: one row for each row of docs."""
    tables, result = Tables(docs.sparkSession), Tables(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).withColumn("text", normalised(F.col("raw")))
    keyed = rows.select("id", "text", _copy(F.col("raw"), F.col("text")).alias("copy"))
    all_signed = tables.write(keyed.select("id", "copy", "text").mapInArrow(_sign, _SIGNED_DDL))
    # copies are one document from here on, whose id is their number; the signature is a function of their text
    least = F.min("id").alias("least")
    copies = all_signed.groupBy("copy").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.count(F.lit(1)).alias("n"), least)
    signed = tables.write(copies.withColumnRenamed("copy", "id"))
    buckets = signed.select("id", F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = tables.write(buckets.join(pivots, "bucket"))
    ids = members.select("id").distinct()
    near = keyed.select(F.col("copy").alias("id"), "text").join(_few(ids), "id", "left_semi")
    texts = tables.write(near.dropDuplicates(["id"]))
    tried = tables.write(_alike(members.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")), signed))
    links = _confirmed(tried, texts, tables)
    found = components(links, tables)
    # buckets with members in several components may hide a link that no pivot shows
    placed = tables.write(_placed(members.select("id", "bucket"), found, links))
    hubs = placed.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    again = _confirmed(tables.write(_alike(hubs, signed).join(tried, ["a", "b"], "left_anti")), texts, tables)
    links = links.unionByName(again)
    found = components(links, tables)
    placed = _placed(placed.select("id", "bucket"), found, links)
    open_rows = tables.write(placed.select("id", "component", "low").distinct())
    more = _links_of_families(open_rows, signed, texts, tables)
    found = components(links.unionByName(more), tables)
    classes = signed.select(F.col("id").alias("copy"), "n", "least").join(found, F.col("copy") == F.col("node"), "left").select("copy", "n", "least", F.coalesce("component", "copy").alias("class"))
    sizes = classes.groupBy("class").agg(F.sum("n").alias("n_class"), F.min("least").alias("class_id"))
    named = classes.select("copy", "class").join(sizes, "class")
    out = result.write(all_signed.select("id", "copy").join(named, "copy"))
    tables.clear()
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each near-duplicate class, with the columns that docs has: one of the least id, of none if no row has one.

    Null and repeated ids, null texts and empty tables as in near_duplicates; of rows alike in id and text one stays.
    """
    alike = _classed(docs, "doc_id", "text").groupBy("class", "id", "copy").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "copy"))
    tables = Tables(docs.sparkSession)
    keys = [F.col("id").alias("__tw_id"), F.col("copy").alias("__tw_copy")]
    marked = tables.write(alike.join(alike.groupBy("class").agg(best.alias("best")), "class").select(*keys, "n", ((F.col("copy") == F.col("best.copy")) & F.col("id").eqNullSafe(F.col("best.id"))).alias("kept")))
    raw = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumn("__tw_own", _copy(raw, normalised(raw)))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_id")) & (F.col("__tw_own") == F.col("__tw_copy"))
    out = own.join(_few(marked.where("not kept").drop("n", "kept")), match, "left_anti")
    repeated = marked.where("kept and n > 1").drop("n", "kept")
    if not repeated.isEmpty():  # rows that repeat the kept id and text
        repeated = _few(repeated)
        out = out.join(repeated, match, "left_anti").unionByName(out.join(repeated, match, "left_semi").dropDuplicates(["__tw_own"]))
    return out.select(*docs.columns)
