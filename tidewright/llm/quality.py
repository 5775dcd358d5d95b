"""Quality rules: hashed n-gram log-likelihood ratio (DataFrame functions only).

Words and word pairs are hashed into BUCKETS. One pass over the corpus counts each bucket in all
documents (raw) and in documents labelled good (trusted). Each bucket gets PRIOR more raw counts and
their share of trusted ones, so a rare bucket says little in a corpus of any size. A document's score
is the mean over its n-grams of log(trusted) - log(raw), so its length does not count, and every
document is held against the same threshold.

The two multinomials meet in one row of BUCKETS weights, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACE, bounded, let

BUCKETS = 1 << 16
#: Documents that score less are rejected. Good text lies around 0, as all n-grams of the corpus do.
THRESHOLD = -0.08
PRIOR = 32.0
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Trusted ids up to so many are broadcast; beyond, they are joined by a shuffle on the id.
BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text (null: none), split once."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def buckets_of(words: Column) -> Column:
    """The bucket of each word, then of each pair of neighbours."""
    n = F.size(words)
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda w, i: _bucket(w, F.get(words, i + 1)))
    return F.concat(F.transform(words, lambda w: _bucket(w)), pairs)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text, windows compared by a 64-bit hash.

    Windows are sorted by (hash, place), so equal ones are neighbours; the union of the places
    they cover is summed in one pass.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(let(by_hash, places), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids whose labels are all good; rows without an id or a label do not count."""
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__tw_id")).agg(F.min(quality_col).alias("q")).where("q = 1").select("__tw_id")


def ratio_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, weights: for each bucket log(trusted) - log(raw); null if no trusted document has a word."""
    ids = trusted_ids(labels)
    ids = F.broadcast(ids) if bounded(ids, BROADCAST_IDS) else ids
    rows = docs.select(F.col(id_col).alias("__tw_key"), F.col(text_col).alias("t")).join(ids.withColumn("good", F.lit(1)), F.col("__tw_key") == F.col("__tw_id"), "left")
    grams = rows.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(let(words_of(F.col("t")), buckets_of)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    share = F.col("n_good") / F.col("n_raw")
    ratio = lambda x: F.log((x["good"] + PRIOR * share) / ((x["raw"] + PRIOR) * share))
    return one.select(F.when(F.col("n_good") > 0, F.transform("c", ratio)).alias("weights"))


#: The struct that judge adds; no table has a column of this name.
VERDICT = "__tw_verdict"


def judge(docs: DataFrame, weights: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the struct VERDICT: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Null and empty texts have no words and fail; without trusted documents (null weights) score is null and the base rules
    decide alone. Each row is judged by itself, so repeated rows stay; an empty table stays empty; a text is judged
    whole, however long; other columns are neither looked at nor changed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def measures(words: Column) -> Column:
        # the weights are a column of the row, since a lambda may not hold a subquery itself
        score = let(buckets_of(words), lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(F.col("__tw_weights"), x)) / F.nullif(F.size(b), F.lit(0)))
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"), score.alias("score"))

    # by explode, which no filter or projection is pushed through: the measures are taken once for each row
    measured = F.explode(F.transform(F.array(words_of(F.col(text_col))), measures)).alias("__tw_m")
    out = docs.withColumn("__tw_weights", weights.scalar()).select("*", measured).drop("__tw_weights")
    m = F.col("__tw_m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
    verdict = F.struct(
        m["n_words"].alias("n_words"), F.length(F.regexp_replace(text, SPACE, F.lit(""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", F.lit(""))).cast("long").alias("n_symbols"), duplicate_lines(F.col(text_col)).cast("long").alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), m["score"].alias("score"), (~failed & F.coalesce(m["score"] >= threshold, F.lit(True))).alias("kept"),
    )
    return out.withColumn(VERDICT, verdict).drop("__tw_m")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every row of docs, by its id; other columns are not looked at."""
    rows = docs.select("doc_id", "text")
    return judge(rows, ratio_weights(rows, labels)).select("doc_id", f"{VERDICT}.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns that docs has, whatever their names."""
    return judge(docs, ratio_weights(docs, labels)).where(f"{VERDICT}.kept").select(*docs.columns)
