"""Connected components of a link table by alternating large and small stars, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Tables

#: Nodes up to so many (two numbers each) are broadcast with the least node around them; beyond, links are dealt out
#: by node, and Spark splits the links of a hot node.
BROADCAST_NODES = 1_000_000


def _stars(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """Every node's links to other nodes are moved to the least node around it: to greater ones (large) or lesser ones (small)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = both.where("b > a") if large else both
    out = moved.join(F.broadcast(least) if 2 * rows <= BROADCAST_NODES else least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("least").alias("b")))
    out = out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return out.coalesce(1 + rows // Tables.ROWS).distinct()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, component: the least node of each component, for each node of links (columns a, b, not null).

    Links are written to tables, so a lost executor costs no earlier round; rounds grow with the logarithm of the
    nodes. Nodes with many links are only ever aggregated or joined, never gathered.
    """

    def size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first())

    links = tables.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = size(links)
    while mark[0]:
        # a star has no more links than there were, or nodes
        rows = 2 * mark[0]
        links = tables.write(_stars(_stars(links, True, rows), False, rows), rows)
        now = size(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
