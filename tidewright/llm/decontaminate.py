"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A mask is a row of positions that count (1) or are ignored (0). Under each mask every window of a
text's normalised words is hashed without its ignored words, so a window still hits after words at
ignored positions were replaced. Hashes of benchmark items and of documents are joined; for each
document and item the hits fix diagonals (place in the document minus place in the item), along
which all words are compared. An item leaked if at least MIN_OVERLAP of its words are met on one diagonal,
or on all diagonals together that have a stretch of DENSE words met in SPAN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import NOT_ALNUM, bounded, checkpointed, let

#: Masks of three words in five at most: however half of the words of an item of LONG words or more are replaced, one hits.
MASKS, LONG = ("111", "1101", "1011", "10101", "11001"), 13
#: Sizes of LONG or more of which that one hit may be the only one on the diagonal; all others, and DENSE words in SPAN, leave two.
ONE_HIT = (13, 14, 16, 18)
#: The same for items of WHOLE words or more; shorter ones are looked up by all their words.
PAIRS, WHOLE = ("11", "101"), 7
MIN_OVERLAP = 0.5
DENSE, SPAN = 5, 7
#: Benchmark hashes, and hits, up to so many rows are broadcast; beyond, the joins are dealt out by key.
BROADCAST_SEEDS, BROADCAST_HITS = 1_000_000, 100_000


def tokens(text: Column) -> Column:
    """Hashes of the normalised words (lower case letters and numbers) of a text; null has none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM, " "))
    return let(plain, lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(t, " "), lambda w: F.xxhash64(w))))


def _seeds(h: Column, masks: tuple[str, ...]) -> Column:
    """Per mask an array of the hashes of all its windows."""

    def one(mask: str) -> Column:
        places = [i for i, c in enumerate(mask) if c == "1"]
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (len(mask) - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(F.lit(int("1" + mask, 2)), *(x if p == 0 else F.get(h, i + p) for p in places)))

    return F.array(*map(one, masks))


def _version(text: Column) -> Column:
    """A digest that tells texts of one id apart."""
    return F.xxhash64(F.lit("version"), text)


def _exploded(rows: DataFrame, key: str, masks: tuple[str, ...], place: str) -> DataFrame:
    """key, place and seed of each window."""
    each = rows.select(key, F.explode(let(F.col("h"), lambda h: _seeds(h, masks))).alias("s"))
    return each.select(key, F.posexplode("s").alias(place, "seed"))


def _overlaps(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, min_overlap: float) -> DataFrame:
    """doc (id, own: a digest of its text), item, version, n_item, matched, shift and overlap of each text and version of an item that leaked into it."""
    known = items.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("t")).where(F.size("t") > 0).withColumn("version", F.xxhash64("t")).distinct()
    sizes = sorted(r[0] for r in known.select(F.size("t")).where(F.size("t") < LONG).distinct().collect())  # twelve at most
    whole = ["1" * n for n in sizes if n < WHOLE]
    masks = tuple(dict.fromkeys((*MASKS, *(PAIRS if sizes and sizes[-1] >= WHOLE else ()), *whole)))
    keyed = known.select(F.struct("item", "version", F.size("t").alias("n")).alias("key"), F.col("t").alias("h"))
    seeds = _exploded(keyed.where(F.size("h") >= LONG), "key", MASKS, "at").unionByName(_exploded(keyed.where(F.size("h").between(WHOLE, LONG - 1)), "key", PAIRS, "at"))
    for mask in whole:  # a whole mask is for items of its length alone
        seeds = seeds.unionByName(_exploded(keyed.where(F.size("h") == len(mask)), "key", (mask,), "at"))
    numbered = seeds.select("seed", "at", "key.item", "key.version", "key.n").distinct()
    small = bounded(numbered, BROADCAST_SEEDS)
    hint = F.broadcast if small else (lambda df: df)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), _version(F.col(text_col)).alias("own")).alias("doc"), F.col(text_col).alias("x"))
    windows = _exploded(rows.select("doc", tokens(F.col("x")).alias("h")), "doc", masks, "place")
    met_seeds = windows.join(hint(numbered), "seed").groupBy("doc", "item", "version", "n", (F.col("place") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("times"))
    hits = met_seeds.where((F.col("times") > 1) | (F.col("n") < LONG) | F.col("n").isin(*ONE_HIT))
    hits = checkpointed(hits.groupBy("doc").agg(F.collect_list(F.struct("item", "version", "shift")).alias("hits")))
    found = F.broadcast(hits) if bounded(hits, BROADCAST_HITS) else hits
    again = rows.join(found.withColumnRenamed("doc", "hit_doc"), F.col("doc.id").eqNullSafe(F.col("hit_doc.id")) & (F.col("doc.own") == F.col("hit_doc.own")))
    pairs = again.select("doc", tokens(F.col("x")).alias("h"), "hits").select("doc", "h", F.explode("hits").alias("hit")).select("doc", "h", "hit.item", "hit.version", "hit.shift")
    versions = known.select(F.col("item").alias("known_item"), F.col("version").alias("known_version"), "t")
    versions = F.broadcast(versions) if small else versions
    pairs = pairs.join(versions, F.col("item").eqNullSafe(F.col("known_item")) & (F.col("version") == F.col("known_version")))
    met = F.filter(F.transform("t", lambda x, i: F.when(F.get("h", i + F.col("shift")) == x, i)), lambda i: i.isNotNull())
    pairs = pairs.select("doc", "item", "version", "shift", F.size("t").cast("long").alias("n_item"), met.alias("met"))
    dense = let(F.col("met"), lambda m: F.exists(F.transform(m, lambda x, i: F.coalesce(F.get(m, i + (DENSE - 1)) - x < SPAN, F.lit(False))), lambda d: d))
    pairs = pairs.withColumn("dense", dense).where(F.col("dense") | (F.size("met") >= min_overlap * F.col("n_item")))
    joint = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("dense"), F.col("met"))))))
    pairs = pairs.groupBy("doc", "item", "version", "shift").agg(F.first("n_item").alias("n_item"), F.first("met").alias("met"), F.first("dense").alias("dense"))  # repeated rows
    first = F.coalesce(F.min(F.when(F.col("dense"), F.col("shift"))), F.max_by("shift", F.size("met")))
    best = pairs.groupBy("doc", "item", "version").agg(F.first("n_item").alias("n_item"), F.greatest(joint, F.max(F.size("met"))).cast("long").alias("matched"), first.alias("shift"))
    return best.withColumn("overlap", F.col("matched") / F.col("n_item")).where(F.col("overlap") >= min_overlap)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """id, item_id, n_item, matched, overlap and place: a row for each document and item that leaked into it.

    Null and wordless texts and items leak nothing. Items shorter than WHOLE words are looked up by a mask of their
    own length without ignored words. With a min_overlap below MIN_OVERLAP an item may be missed. Each text of docs is
    judged by itself, and each of items; of those with one id (null is an id too) the best overlap is returned. Empty
    tables give an empty result; other columns are not looked at.
    """
    best = _overlaps(docs, items, id_col, text_col, item_col, item_text, min_overlap)
    top = F.max(F.struct("overlap", "n_item", "matched", "shift"))
    out = best.groupBy(F.col("doc.id").alias("doc"), "item").agg(top.alias("b"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.n_item", "b.matched", "b.overlap", F.greatest(F.col("b.shift"), F.lit(0)).cast("long").alias("place"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs into whose own text no item leaked, with the columns that docs has."""
    leaked = _overlaps(docs, items, "doc_id", "text", "item_id", "text", MIN_OVERLAP).select(F.col("doc.id").alias("__tw_leaked"), F.col("doc.own").alias("__tw_version")).distinct()
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col("__tw_leaked")) & (_version(F.col("text")) == F.col("__tw_version")), "left_anti")
