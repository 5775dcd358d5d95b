"""Queries over the tables of the test data, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import history, prepare
from tidewright.functions.cluster import Tables, with_position
from tidewright.model import OrderDependency, all_keys, compatible, constant, to_frame, to_text
from tidewright.operators import report, validate, violations
from tidewright.operators.classes import ClassIndex, KeptExtremes
from tidewright.operators.compare import compare_frames
from tidewright.operators.dominance import Blocks
from tidewright.operators.engine import OdEngine, discover
from tidewright.streaming.feed import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def constant_od_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """For four contexts of orders, whether status and priority are constant in every class."""
    contexts = {"totalprice": ["o_totalprice"], "custkey": ["o_custkey"], "custkey,orderdate": ["o_custkey", "o_orderdate"], "orderkey": ["o_orderkey"]}
    groups = validate.constant_groups(table(spark, sf, "orders"), contexts, ["o_orderstatus", "o_orderpriority"])
    flag = lambda c: F.max(F.col(f"lo_{c}") != F.col(f"hi_{c}")).alias(f"violated_{c}")
    return groups.groupBy("gid").agg(flag("o_orderstatus"), flag("o_orderpriority"), F.count(F.lit(1)).alias("classes"))


def split_classes(spark: SparkSession, sf: str) -> DataFrame:
    return validate.split_classes(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


def constant_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    found = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderstatus", "o_orderkey")).alias("x"), F.max(F.struct("o_orderstatus", "o_orderkey")).alias("y"))
    return found.where("x.o_orderstatus <> y.o_orderstatus").select("o_custkey", F.col("x.o_orderkey").alias("t1"), F.col("y.o_orderkey").alias("t2"))


def swap_classes(same: bool) -> Query:
    return lambda spark, sf: validate.violating_classes(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], "l_quantity", "l_discount", same)


def _verdicts(df: DataFrame, ods: list[OrderDependency], columns: list[str]) -> DataFrame:
    bad = validate.broken(df, columns, ods)
    return df.sparkSession.createDataFrame([(to_text(od, columns), od not in bad) for od in ods], "od string, holds boolean")


def compatible_od_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    customer, part = table(spark, sf, "customer"), table(spark, sf, "part")
    one = _verdicts(customer, [compatible([], 0, 1), compatible([], 0, 2), compatible([1], 0, 2, False)], ["c_custkey", "c_nationkey", "c_acctbal"])
    two = _verdicts(part, [compatible([], 0, 1), compatible([1], 0, 2)], ["p_partkey", "p_size", "p_retailprice"])
    return one.unionByName(two)


def empty_context_swap(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    groups = validate.swap_groups(customer, [], "c_custkey", [("c_name", True), ("c_acctbal", True)])
    flag = lambda b: F.coalesce(F.max(validate.swap_condition(b, True)), F.lit(False)).alias(f"swap_{b}")
    return groups.agg(flag("c_name"), flag("c_acctbal"))


def swap_count_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return violations.swap_pairs(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice")


def _change(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem").select(F.concat_ws(":", *LINES).alias("tid"), *LINES, "l_quantity", "l_tax")
    return lines.where("l_orderkey % 97 <> 0"), lines.where("l_orderkey % 97 = 0")


def insert_split_violators(spark: SparkSession, sf: str) -> DataFrame:
    return violations.split_violators(*_change(spark, sf), ["l_partkey", "l_suppkey"], "l_quantity", "tid")


def insert_swap_violators(spark: SparkSession, sf: str) -> DataFrame:
    return violations.swap_violators(*_change(spark, sf), ["l_partkey"], "l_quantity", "l_tax", "tid")


def difference_masks(spark: SparkSession, sf: str) -> DataFrame:
    return violations.difference_masks(*_change(spark, sf), ["l_partkey"], "l_quantity", ["l_orderkey", "l_suppkey", "l_linenumber", "l_tax"])


def minimal_difference_masks(spark: SparkSession, sf: str) -> DataFrame:
    return violations.minimal_masks(difference_masks(spark, sf))


def stripped_partition_sizes(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    contexts = (["l_orderkey"], ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    parts = [validate.stripped_sizes(lines, c).withColumn("context", F.lit(",".join(c))) for c in contexts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def min_max_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return violations.min_max_clusters(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")


def clusters_to_check(spark: SparkSession, sf: str) -> DataFrame:
    base, delta = _change(spark, sf)
    return violations.clusters_to_check(base, delta, ["l_partkey"], "l_quantity", "l_tax", "tid")


def dense_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.rank_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", "o_totalprice"])


def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.distinct_counts(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.lit(1).alias("fixed")))


def date_inference(spark: SparkSession, sf: str) -> DataFrame:
    """The format of five text columns of orders, one of them no date."""
    day = F.col("o_orderdate")
    orders = table(spark, sf, "orders").select(F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "MM/dd/yyyy").alias("american"), F.date_format(day, "dd.MM.yyyy").alias("dotted"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), "o_orderpriority")
    found = prepare.date_formats(orders)
    return spark.createDataFrame([(c, found.get(c)) for c in orders.columns], "column string, format string")


def batch_split(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").count()
    out = prepare.batches(table(spark, sf, "orders").select("o_orderkey"), [n // 2, n // 4], F.col("o_orderkey"))
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    return with_position(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey").desc()], "place")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", op.alias("op"))


def cdc_final_state(spark: SparkSession, sf: str) -> DataFrame:
    return history.final_state(_events(spark, sf).select("event_id", "ts", "user_id", "op", "value"), "user_id", ["ts", "event_id"], "op").select("user_id", "event_id", "op", "value")


def cdc_update_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return history.expand_updates(_events(spark, sf), "user_id", ["ts", "event_id"], "op", ["value", "props"]).select("user_id", "event_id", "op", "value", "props")


def cdc_changed_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return history.changed_mask(_events(spark, sf), "user_id", ["ts", "event_id"], ["event_type", "value", "props"]).select("event_id", "mask")


def baseline_inserts(spark: SparkSession, sf: str) -> DataFrame:
    return history.baseline_inserts(_events(spark, sf), ["ts", "event_id"], "op").select("event_id", "user_id")


def event_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.counts_by(_events(spark, sf).withColumn("day", F.to_date("ts")), "day", "event_type", ["view", "signup", "error", "click", "purchase"]).withColumn("day", F.col("day").cast("string"))


def state_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    sparse = _events(spark, sf).withColumn("price", F.when(F.col("event_type") == "purchase", F.col("value")))
    return history.carried_forward(sparse, "user_id", ["ts", "event_id"], ["price"]).select("event_id", "price")


def surviving_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey").join(orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti")


def dead_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("gone"))
    ends = constant_witnesses(spark, sf).select("o_custkey", F.explode(F.array("t1", "t2")).alias("t"))
    return ends.join(gone, F.col("t") == F.col("gone")).select("o_custkey").distinct()


def delete_by_value(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return violations.delete_by_value(orders, orders.where("o_orderkey % 5 = 0"), ["o_custkey", "o_orderstatus"], "o_orderkey")


def od_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    names = ["n_nationkey", "n_name", "n_regionkey"]
    found = to_frame(spark, discover(table(spark, sf, "nation"), names), names)
    expected = to_frame(spark, {constant([0], 1), constant([0], 2), constant([1], 0), constant([2], 0)}, names)
    return compare_frames(found, expected)


def superkey_check(spark: SparkSession, sf: str) -> DataFrame:
    contexts = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]}
    return spark.createDataFrame([(t, validate.is_superkey(table(spark, sf, t), c)) for t, c in contexts.items()], "context string, is_key boolean")


def metric_rates(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).select("event_type", "event_id", "value")
    return report.rates(log, "event_type", "event_id", "value").select("event_type", "event_id", "d_step", F.round("d_time", 6).alias("d_time"), F.round("rate", 6).alias("rate"))


def metric_as_of(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).select("event_type", "event_id", "value")
    points = log.select("event_type").distinct().select("event_type", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 1000, 5000, 100000000)])).alias("step"))
    return report.as_of(log, points, "event_type", "event_id", "value", "step")


def metric_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    out = report.mean_std(_events(spark, sf), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def relative_runtime(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).withColumn("k", F.col("user_id") % 10)
    return report.relative(log, "k", "event_type", "value", "view").select("k", "event_type", F.round("relative", 6).alias("relative"))


def ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).withColumn("k", F.col("user_id") % 50)
    out = report.ratio_table(log.where("event_type = 'click'"), log.where("event_type = 'purchase' and k < 40"), "k", "value")
    return out.select("k", F.round("one", 6).alias("one"), F.round("two", 6).alias("two"), F.round("ratio", 6).alias("ratio"), "status")


def windowed_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = windowed_counts(_events(spark, sf), "ts", "event_type", "1 day", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "kind", "n")


#: Tables whose covers are discovered, and their columns.
DISCOVERED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]}
CHANGED = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"]


def discover_minimal_cover(spark: SparkSession, sf: str) -> DataFrame:
    parts = [to_frame(spark, discover(table(spark, sf, t), names), names).select("od", "kind") for t, names in DISCOVERED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def maximal_non_ods(spark: SparkSession, sf: str) -> DataFrame:
    names = DISCOVERED["nation"]
    engine = OdEngine(table(spark, sf, "nation").withColumn("_tid", F.col("n_nationkey").cast("long")), names)
    return to_frame(spark, engine.non_ods(), names).select("od")


def cover_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The cover of four columns of orders after a batch of inserts and a batch of deletes."""
    orders = table(spark, sf, "orders").withColumn("_tid", F.col("o_orderkey").cast("long"))
    engine = OdEngine(orders.where("o_orderkey % 97 <> 0"), CHANGED)
    engine.insert(orders.where("o_orderkey % 97 = 0"))
    engine.delete(orders.where("o_orderkey % 89 = 0").select("_tid"))
    return engine.to_frame().select("od")


def cover_after_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The cover of four columns of orders after a batch of changes by record: two columns updated, some rows deleted and put in anew."""
    orders = table(spark, sf, "orders").withColumn("_tid", F.col("o_orderkey").cast("long"))
    engine = OdEngine(orders, CHANGED)
    moved = orders.where("o_orderkey % 89 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_custkey": F.col("o_custkey") % 10})
    gone = orders.where("o_orderkey % 97 = 0 and o_orderkey % 89 <> 0")
    feed = lambda rows, op, place: rows.select(F.lit(op).alias("_op"), F.col("_tid").alias("_rid"), (F.col("_tid") * 3 + place).alias("_seq"), *CHANGED)
    engine.apply(feed(moved, "update", 0).unionByName(feed(gone, "delete", 1)).unionByName(feed(gone.where("o_orderkey % 2 = 0"), "insert", 2)))
    return engine.to_frame().select("od")


def class_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """For each changed line how many lines of the table are of its part and supplier, out of an index that is not shuffled."""
    base, delta = _change(spark, sf)
    index = ClassIndex(base.select("tid", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], 16)
    found = Tables(spark).write(index.look_up(delta.select("tid", "l_partkey", "l_suppkey")).groupBy(F.col("d_tid").alias("delta_id")).agg(F.count(F.lit(1)).alias("n")))
    index.drop()
    return found


def kept_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Extremes of discounts by supplier and quantity, kept through an insert and a delete."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount")
    kept = KeptExtremes(lines.where("l_orderkey % 97 <> 0"), ["l_suppkey"], "l_quantity", "l_discount")
    kept.insert(lines.where("l_orderkey % 97 = 0"))
    kept.delete(lines.where("l_orderkey % 89 = 0"), lines.where("l_orderkey % 89 <> 0"))
    return kept.state()


def swap_count_large_classes(spark: SparkSession, sf: str) -> DataFrame:
    return violations.swap_pairs(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_discount", same=False)


def empty_context_violators(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that swap with changed ones on key and balance, in the class of all rows, by a search through blocks."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    base, delta = customer.where("c_custkey % 397 <> 0"), customer.where("c_custkey % 397 = 0")
    return Blocks(base, [], "c_custkey", "c_acctbal", "c_custkey").swaps(delta, [], "c_custkey", "c_acctbal", "c_custkey")


def order_halves(spark: SparkSession, sf: str) -> DataFrame:
    parts = prepare.halves(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), F.col("o_orderkey"))
    return parts[0].withColumn("half", F.lit(1)).unionByName(parts[1].withColumn("half", F.lit(2))).select("o_orderkey", "half")


def attribute_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each attribute is set in the events of a type."""
    attributes = F.array_compact(F.array(F.when(F.col("value") > 20, "value"), F.when(F.col("user_id") % 3 == 0, "user"), F.lit("props")))
    return history.attribute_counts(_events(spark, sf).withColumn("attributes", attributes), "event_type", "attributes")


def first_seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    return history.dense_ids(_events(spark, sf), "event_type", "user_id", F.col("ts"), F.col("event_id")).select("event_id", F.col("id").cast("long").alias("id"))


def rebuilt_states(spark: SparkSession, sf: str) -> DataFrame:
    """The states of users from single changes, a step a day: what is viewed and clicked, a small value taking it away."""
    day, value = F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("value") >= 15, F.floor("value").cast("string"))
    changes = _events(spark, sf).select("user_id", day.alias("day"), "event_type", value.alias("v"))
    return history.rebuild(changes, "user_id", "day", "event_type", "v", ["view", "click"]).select("user_id", "day", F.col("event_type").alias("kind"), "view", "click")


def allowed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The events whose group of users is among those that have a large value of the type."""
    events = _events(spark, sf).withColumn("attribute", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))
    stats = events.where("value > 150").groupBy(F.col("event_type").alias("infobox_name")).agg(F.map_from_entries(F.collect_set(F.struct("attribute", F.lit(1)))).alias("attributes"))
    return history.only_allowed(events, "event_type", "attribute", history.allowed_attributes(stats)).select("event_id")


def first_runs(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return report.first_run(log, ["event_type", "day"], "user_id").select("event_id")


def last_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.last_row(_events(spark, sf).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("user_id") % 10
    status = report.status(F.col("value") > 60, k == 3, F.when(k > 1, F.col("value")))
    return _events(spark, sf).groupBy("event_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return {
        "constant_od_verdicts": constant_od_verdicts, "constant_od_split_classes": split_classes, "constant_od_witness": constant_witnesses,
        "compatible_od_up_violating_classes": swap_classes(True), "compatible_od_down_violating_classes": swap_classes(False), "compatible_od_verdicts": compatible_od_verdicts,
        "empty_context_swap": empty_context_swap, "swap_count_pairs": swap_count_pairs, "insert_split_violators": insert_split_violators, "insert_swap_violators": insert_swap_violators,
        "difference_masks": difference_masks, "minimal_difference_masks": minimal_difference_masks, "stripped_partition_sizes": stripped_partition_sizes, "min_max_clusters": min_max_clusters,
        "clusters_to_check": clusters_to_check, "dense_rank_encode": dense_ranks, "distinct_counts": distinct_counts, "date_inference": date_inference, "batch_split": batch_split,
        "row_positions": row_positions, "cdc_final_state": cdc_final_state, "cdc_update_expansion": cdc_update_expansion, "cdc_changed_attributes": cdc_changed_attributes,
        "baseline_inserts": baseline_inserts, "event_type_counts": event_type_counts, "state_carry_forward": state_carry_forward, "surviving_after_delete": surviving_after_delete,
        "dead_witnesses": dead_witnesses, "delete_by_value": delete_by_value, "od_set_diff": od_set_diff, "superkey_check": superkey_check, "metric_rates": metric_rates,
        "metric_as_of": metric_as_of, "metric_mean_std": metric_mean_std, "relative_runtime": relative_runtime, "ratio_table": ratio_table, "windowed_event_counts": windowed_event_counts,
        "discover_minimal_cover": discover_minimal_cover, "maximal_non_ods": maximal_non_ods, "cover_after_changes": cover_after_changes,
        "cover_after_updates": cover_after_updates, "class_lookup": class_lookup, "kept_extremes": kept_extremes, "swap_count_large_classes": swap_count_large_classes,
        "empty_context_violators": empty_context_violators, "order_halves": order_halves, "attribute_counts": attribute_counts, "first_seen_ids": first_seen_ids,
        "rebuilt_states": rebuilt_states, "allowed_changes": allowed_changes, "first_runs": first_runs, "last_rows": last_rows, "run_status": run_status,
    }


_TID = "concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
_EVENTS = "(SELECT *, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op FROM events)"
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_WITNESS = "SELECT o_custkey, min({'s': o_orderstatus, 'k': o_orderkey}).k AS t1, max({'s': o_orderstatus, 'k': o_orderkey}).k AS t2 FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)"
_PAIRS = "FROM lineitem b JOIN lineitem d ON b.l_orderkey % 97 <> 0 AND d.l_orderkey % 97 = 0"
_MASKS = f"""SELECT ((b.l_orderkey <> d.l_orderkey)::BIGINT + 2 * (b.l_suppkey <> d.l_suppkey)::BIGINT + 4 * (b.l_linenumber <> d.l_linenumber)::BIGINT + 8 * (b.l_tax <> d.l_tax)::BIGINT) AS mask, count(*) AS n
    {_PAIRS} AND b.l_partkey = d.l_partkey AND b.l_quantity <> d.l_quantity GROUP BY 1"""


def _swaps(wrong: str) -> str:
    keys = "l_returnflag, l_linestatus, l_suppkey"
    return f"""WITH g AS (SELECT {keys}, l_quantity AS a, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY ALL),
      w AS (SELECT *, max(hi) OVER p AS top, min(lo) OVER p AS low FROM g WINDOW p AS (PARTITION BY {keys} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT DISTINCT {keys} FROM w WHERE {wrong}"""


def _no_swap(table: str, a: str, b: str, context: str = "", same: bool = True) -> str:
    wrong = "top > lo" if same else "low < hi"
    part = f"PARTITION BY {context}" if context else ""
    keys = f"{context}, " if context else ""
    return f"""(SELECT coalesce(bool_and(NOT ({wrong})), true) FROM (SELECT *, max(hi) OVER p AS top, min(lo) OVER p AS low FROM
      (SELECT {keys}{a} AS a, min({b}) AS lo, max({b}) AS hi FROM {table} GROUP BY ALL) WINDOW p AS ({part} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE top IS NOT NULL)"""


def _verdict(context: str) -> str:
    return f"""SELECT '{context.replace('o_', '').replace(' ', '')}' AS gid, bool_or(a <> b) AS violated_o_orderstatus, bool_or(c <> d) AS violated_o_orderpriority, count(*) AS classes FROM
      (SELECT min(o_orderstatus) a, max(o_orderstatus) b, min(o_orderpriority) c, max(o_orderpriority) d FROM orders GROUP BY {context})"""


def _stripped(context: str) -> str:
    return f"SELECT count(*) AS classes, coalesce(sum(n), 0)::BIGINT AS rows_in_classes, '{context}' AS context FROM (SELECT count(*) AS n FROM lineitem GROUP BY {context} HAVING count(*) > 1)"


def _lattice(source: str, names: list[str]) -> str:
    """SQL for every dependency of a table in every context: od, kind, its key, the context's mask, and whether it holds."""
    rows = []
    for key in all_keys(len(names)):
        for context in range(1 << len(names)):
            if context & key.mask:
                continue
            within = ", ".join(names[i] for i in range(len(names)) if context >> i & 1)
            text = to_text(OrderDependency(key, context), names)
            if key.constant:
                a = names[key.left]
                holds = f"(SELECT coalesce(bool_and(lo = hi), true) FROM (SELECT min({a}) AS lo, max({a}) AS hi FROM {source}{f' GROUP BY {within}' if within else ''}))"
            else:
                holds = _no_swap(source, names[key.left], names[key.right], within, key.same)
            rows.append(f"SELECT '{text}' AS od, '{'constant' if key.constant else 'compatible'}' AS kind, {key.left} AS a, {key.right} AS b, {str(key.same).lower()} AS same, {context} AS ctx, {holds} AS holds")
    return " UNION ALL ".join(rows)


def _cover(source: str, names: list[str], columns: str) -> str:
    """SQL for the minimal cover: what holds in no smaller context, and is not implied by a constant side."""
    return f"""SELECT {columns} FROM (WITH v AS MATERIALIZED ({_lattice(source, names)}) SELECT * FROM v WHERE holds
      AND NOT EXISTS (SELECT 1 FROM v o WHERE o.holds AND (o.a, o.b, o.same) = (v.a, v.b, v.same) AND o.ctx <> v.ctx AND o.ctx & v.ctx = o.ctx)
      AND NOT EXISTS (SELECT 1 FROM v o WHERE v.b >= 0 AND o.b < 0 AND o.holds AND o.a IN (v.a, v.b) AND o.ctx & v.ctx = o.ctx))"""


def oracle_sql() -> dict[str, str]:
    expected = ", ".join(f"('{x}')" for x in ("{n_nationkey}: [] ↦ n_name", "{n_nationkey}: [] ↦ n_regionkey", "{n_name}: [] ↦ n_nationkey", "{n_regionkey}: [] ↦ n_nationkey"))
    formats = {"iso": ("%Y-%m-%d", "o_orderdate"), "american": ("%m/%d/%Y", "o_orderdate"), "dotted": ("%d.%m.%Y", "o_orderdate"), "stamp": ("%Y-%m-%dT%H:%M:%SZ", "o_orderdate"), "o_orderpriority": (None, "o_orderpriority")}
    tried = ("%Y-%m-%dT%H:%M:%SZ", "%m/%d/%Y", "%d.%m.%Y", "%Y-%m-%d")
    shown = lambda f, c: f"strftime({c}, '{f}')" if f else c
    reads = lambda f, c, t: f"WHEN bool_and(try_strptime({shown(f, c)}, '{t}') IS NOT NULL) THEN '{t}'"
    return {
        "constant_od_verdicts": " UNION ALL ".join(map(_verdict, ("o_totalprice", "o_custkey", "o_custkey,o_orderdate", "o_orderkey"))),
        "constant_od_split_classes": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS lo, max(l_partkey) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING min(l_partkey) <> max(l_partkey)",
        "constant_od_witness": _WITNESS,
        "compatible_od_up_violating_classes": _swaps("top > lo"),
        "compatible_od_down_violating_classes": _swaps("low < hi"),
        "compatible_od_verdicts": f"""SELECT '{{}}: c_custkey↑ ~ c_nationkey↑' AS od, {_no_swap('customer', 'c_custkey', 'c_nationkey')} AS holds
          UNION ALL SELECT '{{}}: c_custkey↑ ~ c_acctbal↑', {_no_swap('customer', 'c_custkey', 'c_acctbal')}
          UNION ALL SELECT '{{c_nationkey}}: c_custkey↑ ~ c_acctbal↓', {_no_swap('customer', 'c_custkey', 'c_acctbal', 'c_nationkey', False)}
          UNION ALL SELECT '{{}}: p_partkey↑ ~ p_size↑', {_no_swap('part', 'p_partkey', 'p_size')}
          UNION ALL SELECT '{{p_size}}: p_partkey↑ ~ p_retailprice↑', {_no_swap('part', 'p_partkey', 'p_retailprice', 'p_size')}""",
        "empty_context_swap": f"SELECT NOT {_no_swap('customer', 'c_custkey', 'c_name')} AS swap_c_name, NOT {_no_swap('customer', 'c_custkey', 'c_acctbal')} AS swap_c_acctbal",
        "swap_count_pairs": "SELECT x.o_custkey, count(*) AS pairs FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderdate < y.o_orderdate AND x.o_totalprice > y.o_totalprice GROUP BY 1",
        "insert_split_violators": f"SELECT {_TID.replace('l_', 'd.l_')} AS delta_id, {_TID.replace('l_', 'b.l_')} AS base_id {_PAIRS} AND b.l_partkey = d.l_partkey AND b.l_suppkey = d.l_suppkey AND b.l_quantity <> d.l_quantity",
        "insert_swap_violators": f"SELECT {_TID.replace('l_', 'd.l_')} AS delta_id, {_TID.replace('l_', 'b.l_')} AS base_id {_PAIRS} AND b.l_partkey = d.l_partkey AND ((b.l_quantity < d.l_quantity AND b.l_tax > d.l_tax) OR (b.l_quantity > d.l_quantity AND b.l_tax < d.l_tax))",
        "difference_masks": _MASKS,
        "minimal_difference_masks": f"WITH m AS ({_MASKS}) SELECT mask FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.mask <> m.mask AND m.mask & o.mask = o.mask)",
        "stripped_partition_sizes": " UNION ALL ".join(map(_stripped, ("l_orderkey", "l_partkey,l_suppkey", "l_orderkey,l_linenumber"))),
        "min_max_clusters": "SELECT l_suppkey, l_quantity, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "clusters_to_check": f"""WITH c AS (SELECT l_partkey, l_quantity, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY 1, 2)
          SELECT {_TID.replace('l_', 'd.l_')} AS delta_id, c.l_quantity, lo, hi FROM c JOIN lineitem d ON d.l_orderkey % 97 = 0 AND c.l_partkey = d.l_partkey
          AND ((c.l_quantity < d.l_quantity AND hi > d.l_tax) OR (c.l_quantity > d.l_quantity AND lo < d.l_tax))""",
        "dense_rank_encode": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority NULLS FIRST)::INTEGER AS o_orderpriority, dense_rank() OVER (ORDER BY o_totalprice NULLS FIRST)::INTEGER AS o_totalprice FROM orders",
        "distinct_counts": " UNION ALL ".join(f"SELECT '{n}' AS column, count(DISTINCT {c}) AS n_distinct, (count(*) - count({c}))::BIGINT AS n_null FROM customer" for n, c in (("c_custkey", "c_custkey"), ("c_nationkey", "c_nationkey"), ("c_mktsegment", "c_mktsegment"), ("fixed", "1"))),
        "date_inference": " UNION ALL ".join(f"SELECT '{n}' AS column, CASE {' '.join(reads(f, c, t) for t in tried)} END AS format FROM orders" for n, (f, c) in formats.items()),
        "batch_split": "SELECT batch::INTEGER AS batch, n::BIGINT AS n FROM (SELECT count(*) AS c FROM orders), LATERAL (VALUES (0, c // 2), (1, c // 4), (2, c - c // 2 - c // 4)) v(batch, n)",
        "row_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders",
        "cdc_final_state": f"SELECT user_id, event_id, op, value FROM {_EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND op <> 'delete'",
        "cdc_update_expansion": f"""WITH e AS (SELECT *, lag(value) OVER w AS v0, lag(props) OVER w AS p0 FROM {_EVENTS} WINDOW w AS {_W})
          SELECT user_id, event_id, 'delete' AS op, v0 AS value, p0 AS props FROM e WHERE op <> 'insert' UNION ALL SELECT user_id, event_id, 'insert', value, props FROM e WHERE op <> 'delete'""",
        "cdc_changed_attributes": f"""SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 7 ELSE (event_type IS DISTINCT FROM lag(event_type) OVER w)::BIGINT + 2 * (value IS DISTINCT FROM lag(value) OVER w)::BIGINT
          + 4 * (props IS DISTINCT FROM lag(props) OVER w)::BIGINT END AS mask FROM events WINDOW w AS {_W}""",
        "baseline_inserts": "WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events WHERE event_type = 'signup') SELECT event_id, user_id FROM e WHERE k <= CASE WHEN n = 1 THEN 1 ELSE n // 2 + 1 END",
        "event_type_counts": "SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "signup", "error", "click", "purchase")) + " FROM events GROUP BY 1",
        "state_carry_forward": f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM events",
        "surviving_after_delete": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
        "dead_witnesses": f"SELECT o_custkey FROM ({_WITNESS}) WHERE t1 % 3 = 0 OR t2 % 3 = 0",
        "delete_by_value": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS k,
          count(*) FILTER (o_orderkey % 5 = 0) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) SELECT o_orderkey FROM r WHERE k <= n""",
        "od_set_diff": f"""SELECT CASE WHEN f.od IS NULL THEN 'missing' WHEN e.od IS NULL THEN 'unexpected' ELSE 'correct' END AS status, coalesce(f.od, e.od) AS od
          FROM ({_cover('nation', DISCOVERED['nation'], 'od')}) f FULL JOIN (VALUES {expected}) e(od) ON f.od = e.od""",
        "superkey_check": " UNION ALL ".join(f"SELECT '{t}' AS context, NOT EXISTS (SELECT 1 FROM {t} GROUP BY {c} HAVING count(*) > 1) AS is_key" for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_linenumber"), ("customer", "c_custkey"))),
        "metric_rates": """SELECT event_type, event_id, event_id - lag(event_id) OVER w AS d_step, round(value - lag(value) OVER w, 6) AS d_time,
          round((value - lag(value) OVER w) / nullif(event_id - lag(event_id) OVER w, 0), 6) AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
        "metric_as_of": """SELECT t.event_type, p.step::BIGINT AS step, (SELECT max({'k': event_id, 'v': value}).v FROM events e WHERE e.event_type = t.event_type AND e.event_id <= p.step) AS value
          FROM (SELECT DISTINCT event_type FROM events) t, (VALUES (0), (100), (1000), (5000), (100000000)) p(step)""",
        "metric_mean_std": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
        "relative_runtime": """WITH m AS (SELECT user_id % 10 AS k, event_type, avg(value) AS mean FROM events GROUP BY 1, 2)
          SELECT m.k, m.event_type, round(m.mean / nullif(b.mean, 0), 6) AS relative FROM m JOIN m b ON m.k = b.k AND b.event_type = 'view'""",
        "ratio_table": """WITH a AS (SELECT user_id % 50 AS k, avg(value) AS one FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id % 50 AS k, avg(value) AS two FROM events WHERE event_type = 'purchase' AND user_id % 50 < 40 GROUP BY 1)
          SELECT a.k, round(one, 6) AS one, round(two, 6) AS two, round(two / nullif(one, 0), 6) AS ratio, CASE WHEN two IS NULL THEN 'missing' ELSE 'ok' END AS status FROM a LEFT JOIN b ON a.k = b.k""",
        "windowed_event_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
        "discover_minimal_cover": " UNION ALL ".join(_cover(t, names, "od, kind") for t, names in DISCOVERED.items()),
        "maximal_non_ods": f"""SELECT od FROM (WITH v AS MATERIALIZED ({_lattice('nation', DISCOVERED['nation'])}) SELECT * FROM v WHERE NOT holds
          AND NOT EXISTS (SELECT 1 FROM v o WHERE NOT o.holds AND (o.a, o.b, o.same) = (v.a, v.b, v.same) AND o.ctx <> v.ctx AND o.ctx & v.ctx = v.ctx))""",
        "cover_after_changes": _cover("(SELECT * FROM orders WHERE o_orderkey % 89 <> 0)", CHANGED, "od"),
        "cover_after_updates": _cover("""(SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_custkey % 10 ELSE o_custkey END AS o_custkey, o_orderdate, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
          FROM orders WHERE o_orderkey % 89 = 0 OR o_orderkey % 97 <> 0 OR o_orderkey % 2 = 0)""", CHANGED, "od"),
        "class_lookup": f"SELECT {_TID.replace('l_', 'd.l_')} AS delta_id, count(*) AS n {_PAIRS} AND b.l_partkey = d.l_partkey AND b.l_suppkey = d.l_suppkey GROUP BY d.l_orderkey, d.l_partkey, d.l_suppkey, d.l_linenumber",
        "kept_extremes": "SELECT l_suppkey, l_quantity, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n FROM lineitem WHERE l_orderkey % 89 <> 0 GROUP BY 1, 2",
        "swap_count_large_classes": """WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity AS a, l_discount AS b, count(*) AS n FROM lineitem GROUP BY ALL)
          SELECT x.l_returnflag, x.l_linestatus, sum(x.n * y.n)::BIGINT AS pairs FROM c x JOIN c y ON x.l_returnflag = y.l_returnflag AND x.l_linestatus = y.l_linestatus AND x.a < y.a AND x.b < y.b GROUP BY 1, 2""",
        "empty_context_violators": """SELECT d.c_custkey AS delta_id, b.c_custkey AS base_id FROM customer b JOIN customer d ON d.c_custkey % 397 = 0 AND b.c_custkey % 397 <> 0
          AND ((b.c_custkey < d.c_custkey AND b.c_acctbal > d.c_acctbal) OR (b.c_custkey > d.c_custkey AND b.c_acctbal < d.c_acctbal))""",
        "order_halves": "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 < (SELECT count(*) // 2 FROM orders) THEN 1 ELSE 2 END AS half FROM orders",
        "attribute_counts": """SELECT event_type, attribute, count(*) AS n FROM (SELECT event_type, 'value' AS attribute FROM events WHERE value > 20 UNION ALL SELECT event_type, 'user' FROM events WHERE user_id % 3 = 0
          UNION ALL SELECT event_type, 'props' FROM events) GROUP BY 1, 2""",
        "first_seen_ids": """WITH f AS (SELECT event_type, user_id, min({'t': ts, 'e': event_id}) AS f FROM events GROUP BY 1, 2), i AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY f) - 1 AS id FROM f)
          SELECT event_id, id FROM events JOIN i USING (event_type, user_id)""",
        "rebuilt_states": """WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS a, CASE WHEN value >= 15 THEN floor(value)::BIGINT::VARCHAR END AS v FROM events WHERE event_type IN ('view', 'click')),
          s AS (SELECT user_id, day, count(*) FILTER (a = 'view') > 0 AS sv, min(v) FILTER (a = 'view') AS v, count(*) FILTER (a = 'click') > 0 AS sc, min(v) FILTER (a = 'click') AS c FROM c GROUP BY 1, 2),
          t AS (SELECT user_id, day, v IS NOT NULL OR c IS NOT NULL AS adds, last_value(CASE WHEN sv THEN {'x': v} END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN sc THEN {'x': c} END IGNORE NULLS) OVER w AS c FROM s
            WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
          m AS (SELECT *, CASE WHEN adds THEN 'add' ELSE 'none' END AS k FROM t WHERE adds OR coalesce(v.x, c.x) IS NULL),
          p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY day) AS before FROM m)
          SELECT user_id, day, CASE WHEN NOT adds THEN 'delete' WHEN before = 'add' THEN 'update' ELSE 'insert' END AS kind, v.x AS view, c.x AS click FROM p WHERE adds OR before = 'add'""",
        "allowed_changes": "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events a WHERE a.value > 150 AND a.event_type = e.event_type AND a.user_id % 40 = e.user_id % 40)",
        "first_runs": "SELECT event_id FROM events QUALIFY user_id = min(user_id) OVER (PARTITION BY event_type, ts::DATE)",
        "last_rows": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "run_status": """SELECT event_type, CASE WHEN user_id % 10 = 3 THEN 'oom' WHEN value > 60 THEN 'timeout' WHEN user_id % 10 <= 1 THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1, 2""",
    }
