"""Histories of records: events to states and back, and text normalisation of their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.cluster import with_position

#: Names of attributes up to so many are broadcast to the changes; beyond, the join is dealt out by name.
BROADCAST_NAMES = 200_000


def normal_type(name: Column) -> Column:
    """A type's name: lower case, without "infobox " (or "infobox_") and "template:" wherever they stand, white space collapsed; null is empty."""
    out = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("infobox_"), F.lit("infobox "))
    out = F.replace(F.replace(out, F.lit("infobox "), F.lit("")), F.lit("template:"), F.lit(""))
    return F.trim(F.regexp_replace(out, r"[\s\x1c-\x1f\x85\xa0]+", " "))


def normal_attribute(name: Column) -> Column:
    """An attribute's name in lower case with _ for spaces; null is empty."""
    return F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit("_"))


def in_feed_order(events: DataFrame, time: str, operation: str) -> DataFrame:
    """events by time, of one time by operation, so that deletes stand before inserts before updates."""
    return events.orderBy(time, operation)


def allowed_attributes(stats: DataFrame) -> DataFrame:
    """name, attributes: the allow-list of each type from rows of statistics (infobox_name, attributes: a map to counts);
    types without a name are left out."""
    return stats.where(F.coalesce(F.col("infobox_name"), F.lit("")) != "").select(F.col("infobox_name").alias("name"), F.coalesce(F.map_keys("attributes"), F.array().cast("array<string>")).alias("attributes"))


def only_allowed(events: DataFrame, kind: str, attribute: str, allowed: DataFrame) -> DataFrame:
    """The changes (one attribute each) of attributes that their type's allow-list has (name, attributes)."""
    pairs = allowed.select(F.col("name").alias("_kind"), F.explode("attributes").alias("_attribute")).distinct()
    return events.join(F.broadcast(pairs) if pairs.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else pairs, (F.col(kind) == F.col("_kind")) & (F.col(attribute) == F.col("_attribute")), "left_semi")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w.-]+", "_")


def type_counts(events: DataFrame, kind: str) -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def attribute_counts(events: DataFrame, kind: str, attributes: str) -> DataFrame:
    """kind, attribute, n: how often each attribute (an array column) occurs in each kind."""
    return events.select(kind, F.explode(attributes).alias("attribute")).groupBy(kind, "attribute").agg(F.count(F.lit(1)).alias("n"))


def dense_ids(df: DataFrame, group: str, key: str, *order: Column) -> DataFrame:
    """df with id: 0, 1, ... for the keys of a group by their first appearance."""
    first = with_position(df, order).groupBy(group, key).agg(F.min("_pos").alias("p"))
    ids = first.withColumn("id", F.row_number().over(Window.partitionBy(group).orderBy("p")) - 1).drop("p")
    return df.join(ids, [group, key])


def carried_forward(events: DataFrame, record: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """events with each column's last known value of the record."""
    w = Window.partitionBy(record).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def rebuild(changes: DataFrame, record: str, time: str, attribute: str, value: str, allowed: Sequence[str]) -> DataFrame:
    """record, time, event_type and one column for each allowed attribute: the states that single changes give.

    Changes of one time are one step, of which the first of an attribute counts (by value where given twice, null last); a
    null value removes it. A step that adds no value makes no event, but one that leaves nothing of a known record is
    a delete, after which the record is unknown. The first event of a record, and the first behind a delete, is an
    insert; later ones are updates with the whole state. Null values of record and time are values like others.
    """
    mine = F.when(F.col(attribute).isin(*allowed), F.col(attribute))
    named = changes.select(F.col(record).alias("r"), F.col(time).alias("t"), mine.alias("a"), F.col(value).cast("string").alias("v")).where("a is not null")
    # a struct of (is null, value) orders values before null
    firsts = [F.min(F.when(F.col("a") == c, F.struct(F.col("v").isNull().alias("gone"), "v"))).alias(f"c{i}") for i, c in enumerate(allowed)]
    steps = named.groupBy("r", "t").agg(*firsts)
    own = [f"c{i}" for i in range(len(allowed))]
    adds = F.greatest(*[F.coalesce(~F.col(f"{c}.gone"), F.lit(False)).cast("int") for c in own], F.lit(0)) > 0
    before = Window.partitionBy("r").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    state = steps.withColumn("adds", adds).withColumns({c: F.last(c, ignorenulls=True).over(before)["v"] for c in own})
    empty = F.coalesce(*[F.col(c) for c in own]).isNull()
    # of steps that could be events, a delete counts only behind an addition
    marked = state.withColumn("kind", F.when(F.col("adds"), "add").when(empty, "none")).where("kind is not null")
    previous = F.lag("kind").over(Window.partitionBy("r").orderBy("t"))
    events = marked.withColumn("previous", previous).where("adds or previous = 'add'")
    kind = F.when(~F.col("adds"), "delete").when(F.col("previous") == "add", "update").otherwise("insert")
    return events.select(F.col("r").alias(record), F.col("t").alias(time), kind.alias("event_type"), *[F.col(c).alias(name) for c, name in zip(own, allowed)])


def final_state(events: DataFrame, record: str, order: Sequence[str], operation: str, delete: str = "delete") -> DataFrame:
    """The last event of each record that was not deleted; by an aggregate, so a long history is no single sort."""
    others = [c for c in events.columns if c not in (record, *order)]
    last = events.groupBy(record).agg(F.max_by(F.struct(*order, *others), F.struct(*order)).alias("s"))
    return last.where(F.col(f"s.{operation}") != delete).select(record, "s.*")


def baseline_inserts(events: DataFrame, order: Sequence[str], operation: str) -> DataFrame:
    """The first n // 2 + 1 of n inserts by order (one of one)."""
    inserts = events.where(F.col(operation) == "insert")
    n = inserts.count()
    keep = 1 if n == 1 else n // 2 + 1
    return with_position(inserts, [F.col(c) for c in order]).where(F.col("_pos") < keep).drop("_pos")


def expand_updates(events: DataFrame, record: str, order: Sequence[str], operation: str, values: Sequence[str]) -> DataFrame:
    """Every update as a delete of the state before and an insert of the new one; deletes carry the state before."""
    w = Window.partitionBy(record).orderBy(*order)
    before = events.withColumn("_before", F.lag(F.struct(*values)).over(w))
    row = lambda op, source: F.struct(F.lit(op).alias(operation), *[source(c).alias(c) for c in values])
    old, new = (lambda c: F.col(f"_before.{c}")), F.col
    parts = F.when(F.col(operation) == "update", F.array(row("delete", old), row("insert", new))).when(F.col(operation) == "delete", F.array(row("delete", old))).otherwise(F.array(row("insert", new)))
    return before.select(record, *order, F.explode(parts).alias("e")).select(record, *order, "e.*")


def changed_mask(events: DataFrame, record: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """events with mask: bit i is set if values[i] differs from the record's event before (all bits for its first)."""
    w = Window.partitionBy(record).orderBy(*order)
    first = F.row_number().over(w) == 1
    bits = [F.when(first | ~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(values)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return events.withColumn("mask", total.cast("long"))
