"""Connected components of a link table, by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import drop
from .common import HOT_ROWS, cut, join_counted, pack


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, component)``, component the smallest node reachable.

    Alternates large-star and small-star contraction (Kiveris et al. 2014), which ends after
    O(log^2 n) rounds.  Each half-round is one aggregation with map-side combine (the smallest
    neighbour, and the degree) and one join in which nodes of high degree are not gathered; a
    list of neighbours is never built.  Every round is written to the shared folder.  Nodes
    without a link are not in the result; an empty table gives no rows.
    """
    edges = cut(pack(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a <> b").distinct()))
    n, seen = edges.count(), None
    while True:
        # Large star: every node hands its larger neighbours to its smallest one.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = _joined(both.where("v > u"), least, "u", 2 * n).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node hands its smaller neighbours to its smallest one.
        large = cut(large, rows=n) if n > HOT_ROWS else large
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = (_joined(large, least, "a", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        before, edges = edges, cut(small, rows=2 * n)
        drop(before, large)
        state = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("s")).first()
        n, state = state["n"], (state["n"], state["s"])
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _joined(rows: DataFrame, least: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with the smallest neighbour of ``key``; n: no key has more rows."""
    return join_counted(rows, cut(least, rows=n), [key], "_n") if n > HOT_ROWS else rows.join(least, key)
