"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks in a region and shards in a rack; every shard has a weight,
and a rack or region weighs the sum of what it holds. A row descends the tree: at each
level every child draws an exponential with the child's weight as its rate, hashed from
(key, child), and the smallest draw wins. So a row moves only if a child's weight changes,
and then only into or out of the subtree whose weight changed: ``grow`` puts a new shard
into a region of its own, hence takes rows only into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 24, 4, 3
#: Rows of a shard are numbered in so many independent parts, so no task holds a shard.
SLOT_PARTS = 64
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> list[Leaf]:
    """The tree of so many equal shards, filled rack by rack and region by region."""
    return [Leaf(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region, so that no other subtree's weight changes."""
    return [*tree, Leaf(max((x.region for x in tree), default=-1) + 1, 0, max((x.shard for x in tree), default=-1) + 1, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}"))), 1, _DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(16**_DIGITS)) / F.lit(float(weight))


def _winner(key: Column, children: dict[int, float], parent: str) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*(F.struct(_draw(key, f"{parent}/{c}", w).alias("d"), F.lit(c).alias("n")) for c, w in sorted(children.items()))))["n"]


def _children(leaves: list[Leaf], attribute: str) -> dict[int, float]:
    weights: dict[int, float] = {}
    for x in leaves:
        weights[getattr(x, attribute)] = weights.get(getattr(x, attribute), 0.0) + x.weight
    return weights


def _chain(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out


def assign(df: DataFrame, key: str, tree: Sequence[Leaf], prefix: str = "") -> DataFrame:
    """df with {prefix}region, {prefix}rack and {prefix}shard (columns of these names are replaced).

    A null key is a key of its own; equal keys share a shard; an empty table stays empty.
    Shards of weight 0 get nothing; negative weights, equal shard numbers and a tree without weight are errors.
    """
    leaves = [x for x in tree if x.weight > 0]
    if not leaves or any(x.weight < 0 for x in tree) or len({x.shard for x in tree}) < len(tree):
        raise ValueError("a tree needs distinct shards, no negative weight and a positive one")
    k, region, rack, shard = F.coalesce(F.col(key).cast("string"), F.lit("\u0000")), f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    df = df.withColumn(region, _winner(k, _children(leaves, "region"), "r"))
    racks = {r: _children([x for x in leaves if x.region == r], "rack") for r in sorted({x.region for x in leaves})}
    df = df.withColumn(rack, _chain([(F.col(region) == r, _winner(k, own, f"r{r}")) for r, own in racks.items()]))
    shards = [((F.col(region) == r) & (F.col(rack) == c), _winner(k, _children([x for x in leaves if (x.region, x.rack) == (r, c)], "shard"), f"r{r}/k{c}")) for r, own in racks.items() for c in sorted(own)]
    return df.withColumn(shard, _chain(shards))


def slots(df: DataFrame, shard: str, order: Sequence[str], parts: int = SLOT_PARTS) -> DataFrame:
    """df with slot, the row's place in its shard from 0 without gaps.

    A shard is cut into parts by a hash of the order columns, so rows of one key with other values fall into other
    parts; counts of the parts (shards x parts rows, so small enough to broadcast) give where each part begins. Rows
    alike in order have an arbitrary order among themselves.
    """
    part, begin = "__tw_part", "__tw_begin"
    named = F.concat_ws("|", F.lit("slot"), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in order])
    df = df.withColumn(part, F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % parts)
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    begins = df.groupBy(shard, part).count().select(shard, part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(begin))
    within = F.row_number().over(Window.partitionBy(shard, part).orderBy(*order))
    return df.withColumn("slot", within.cast("long") - 1).join(F.broadcast(begins), [shard, part]).withColumn("slot", F.col("slot") + F.col(begin)).drop(part, begin)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region and rack of every row of docs.

    Null text counts as no bytes; empty and very long texts are like others; repeated rows get one slot each;
    rows of equal doc_id share a shard. Other columns of docs are not looked at.
    """
    text, tree = F.coalesce(F.col("text"), F.lit("")), layout(shards)
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, "doc_id", tree), "doc_id", grow(tree), "grown_")
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def _sql_winner(children: dict[int, float], parent: str) -> str:
    if len(children) == 1:
        return str(next(iter(children)))
    draws = (f"{{'d': -ln((('0x' || substr(md5(k || '|{parent}/{c}'), 1, {_DIGITS}))::BIGINT + 0.5) / {float(16**_DIGITS):.1f}) / {w!r}, 'n': {c}}}" for c, w in sorted(children.items()))
    return f"list_sort([{', '.join(draws)}])[1].n"


def _sql_descent(tree: Sequence[Leaf], source: str, prefix: str) -> str:
    leaves = list(tree)
    regions = _children(leaves, "region")
    racks = {r: _children([x for x in leaves if x.region == r], "rack") for r in sorted(regions)}
    rack = " ".join(f"WHEN {r} THEN {_sql_winner(own, f'r{r}')}" for r, own in racks.items())
    shard = " ".join(f"WHEN {prefix}region = {r} AND {prefix}rack = {c} THEN {_sql_winner(_children([x for x in leaves if (x.region, x.rack) == (r, c)], 'shard'), f'r{r}/k{c}')}" for r, own in racks.items() for c in sorted(own))
    return f"SELECT *, CASE {shard} END AS {prefix}shard FROM (SELECT *, CASE {prefix}region {rack} END AS {prefix}rack FROM (SELECT *, {_sql_winner(regions, 'r')} AS {prefix}region FROM {source}))"


def oracle_sql(shards: int = SHARDS) -> str:
    """DuckDB SQL of shard_documents; CRC-32 takes two nibbles a byte, its 16-entry table made by the rule of the polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    step = f"xor(a >> 4, ({table})[((xor(a, x)) & 15) + 1])"
    nibbles = "list_transform(range(0, 2 * strlen(t)), lambda i: ('0x' || h[xor(i, 1) + 1])::BIGINT)"
    base = f"""SELECT doc_id, coalesce(doc_id::VARCHAR, chr(0)) AS k, strlen(t) + 8 AS size,
        xor(list_reduce({nibbles}, lambda a, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
        FROM (SELECT doc_id, t, string_split(hex(encode(t)), '') AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""
    tree = layout(shards)
    one = _sql_descent(tree, "base", "")
    two = _sql_descent(grow(tree), "one", "grown_")
    return f"""WITH base AS MATERIALIZED ({base}), one AS ({one}), two AS ({two})
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot|' || k || '|' || text_crc32 || '|' || size), 1, 8))::BIGINT % {SLOT_PARTS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
      grown_shard::INTEGER AS grown_shard, region::INTEGER AS region, rack::INTEGER AS rack FROM two"""
