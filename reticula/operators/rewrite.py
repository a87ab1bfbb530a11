"""Rewrites of networks: functions from arcs to arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .basic import degree, is_suppressible
from .recursion import reach, rounds


def _set(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").groupBy("net_id", "src", "dst").agg(F.min("length").alias("length"))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return _set(edges.union(more.select(*edges.columns)))


def add_children(edges: DataFrame, to: DataFrame) -> DataFrame:
    """A new leaf below every node of ``to``: ids go on after the largest of the network."""
    from pyspark.sql import Window

    top = edges.groupBy("net_id").agg(F.max(F.greatest("src", "dst")).alias("m"))
    n = F.row_number().over(Window.partitionBy("net_id").orderBy("node"))
    new = to.select("net_id", "node").distinct().withColumn("n", n).join(top, "net_id")
    return edges.union(new.select("net_id", F.col("node").alias("src"), (F.col("m") + F.col("n")).alias("dst"), F.lit(None).cast("double")))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("net_id", "src", "dst"), ["net_id", "src", "dst"], "left_anti").select(*edges.columns)


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select("net_id", "node")
    return (edges.join(g.withColumnRenamed("node", "src"), ["net_id", "src"], "left_anti")
            .join(g.withColumnRenamed("node", "dst"), ["net_id", "dst"], "left_anti").select(*edges.columns))


def remove_node(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove nodes and join their parents to their children; a root goes only if one child can take its place.

    ``gone`` (net_id, node): no two of them joined by an arc.  A root with several children stays.
    """
    deg = degree(edges).join(gone.select("net_id", "node").distinct(), ["net_id", "node"], "left_semi")
    out = cut(deg.where("indeg > 0 or outdeg <= 1").select("net_id", "node"))
    above = edges.join(out.withColumnRenamed("node", "dst"), ["net_id", "dst"], "left_semi").select("net_id", "src", F.col("dst").alias("node"), F.col("length").alias("l1"))
    below = edges.join(out.withColumnRenamed("node", "src"), ["net_id", "src"], "left_semi").select("net_id", F.col("src").alias("node"), "dst", F.col("length").alias("l2"))
    joined = above.join(below, ["net_id", "node"]).select("net_id", "src", "dst", (F.col("l1") + F.col("l2")).alias("length"))
    return _set(remove_nodes(edges, out).union(joined.select(*edges.columns)))


def set_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Make ``roots`` (net_id, node) the roots of their trees: the arcs from the old root down to them turn round."""
    up = edges.select("net_id", F.col("dst").alias("node"), F.col("src").alias("above"))
    path = at = cut(roots.select("net_id", "node").join(up, ["net_id", "node"]))
    for _ in rounds(edges):
        at = cut(at.select("net_id", F.col("above").alias("node")).join(up, ["net_id", "node"]))
        if at.isEmpty():
            break
        path = path.union(at)
    turned = path.select("net_id", F.col("above").alias("src"), F.col("node").alias("dst"))
    hit = edges.join(turned.withColumn("_turn", F.lit(True)), ["net_id", "src", "dst"], "left")
    return hit.select("net_id", F.when(F.col("_turn"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("_turn"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "length")


def replace_parent(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (net_id, dst, old, new): arcs old->dst become new->dst."""
    c = changes.select("net_id", "dst", F.col("old").alias("src"), "new")
    return _set(edges.join(c, ["net_id", "src", "dst"], "left").select("net_id", F.coalesce("new", "src").alias("src"), "dst", "length"))


def replace_child(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (net_id, src, old, new): arcs src->old become src->new."""
    c = changes.select("net_id", "src", F.col("old").alias("dst"), "new")
    return _set(edges.join(c, ["net_id", "src", "dst"], "left").select("net_id", "src", F.coalesce("new", "dst").alias("dst"), "length"))


def contract(edges: DataFrame, into: DataFrame) -> DataFrame:
    """``into`` (net_id, node, target): every node becomes its target; loops and parallel arcs go."""
    s = into.select("net_id", F.col("node").alias("src"), F.col("target").alias("s"))
    d = into.select("net_id", F.col("node").alias("dst"), F.col("target").alias("d"))
    both = edges.join(s, ["net_id", "src"], "left").join(d, ["net_id", "dst"], "left")
    return _set(both.select("net_id", F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "length"))


def suppress_unary(edges: DataFrame) -> DataFrame:
    """Contract chains of nodes with one parent and one child; lengths add up.

    Pointer doubling over the chains: every arc into a chain jumps on until it meets a kept
    node, in log2(longest chain) rounds.
    """
    unary = cut(degree(edges).where(is_suppressible()).select("net_id", "node"))
    # hop: what follows an arc's head while that is unary.
    arcs = cut(edges.select("net_id", "src", "dst", F.coalesce("length", F.lit(0.0)).alias("length")))
    hop = cut(arcs.join(unary.withColumnRenamed("node", "src"), ["net_id", "src"], "left_semi").select("net_id", F.col("src").alias("at"), F.col("dst").alias("to"), F.col("length").alias("more")))
    for _ in rounds(edges, doubling=True):
        far = hop.select("net_id", F.col("at").alias("to"), F.col("to").alias("to2"), F.col("more").alias("more2"))
        nxt = cut(hop.join(far, ["net_id", "to"], "left").select("net_id", "at", F.coalesce("to2", "to").alias("to"), (F.col("more") + F.coalesce("more2", F.lit(0.0))).alias("more"), F.col("to2").isNotNull().alias("moved")))
        hop = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    kept = arcs.join(unary.withColumnRenamed("node", "src"), ["net_id", "src"], "left_anti")
    out = kept.join(hop.withColumnRenamed("at", "dst"), ["net_id", "dst"], "left")
    return _set(out.select("net_id", "src", F.coalesce("to", "dst").alias("dst"), (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length")))


def subdivide(edges: DataFrame, where: Column, new_node: Column) -> DataFrame:
    """Arcs under ``where`` get a node in the middle; each half has half the length."""
    whole = edges.where(~F.coalesce(where, F.lit(False)))
    cut_ = edges.where(where).withColumn("_new", new_node)
    half = F.col("length") / 2
    return whole.select(*edges.columns).union(cut_.select("net_id", "src", F.col("_new"), half)).union(cut_.select("net_id", "_new", "dst", half))


def remove_subtrees(edges: DataFrame, seeds: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Remove what is reachable from ``seeds``, not entering ``keep``."""
    return remove_nodes(edges, reach(edges, seeds, keep))


def remove_upwards(edges: DataFrame, gone: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Remove nodes, then ancestors that lost all their children, up to a fixed point."""
    current, doomed = cut(edges), gone.select("net_id", "node").distinct()
    while True:
        parents = current.join(doomed.withColumnRenamed("node", "dst"), ["net_id", "dst"], "left_semi").select("net_id", F.col("src").alias("node")).distinct()
        parents = cut(parents)
        current = cut(remove_nodes(current, doomed))
        doomed = parents.join(current.select("net_id", F.col("src").alias("node")), ["net_id", "node"], "left_anti")
        if keep is not None:
            doomed = doomed.join(keep.select("net_id", "node"), ["net_id", "node"], "left_anti")
        doomed = cut(doomed)
        if doomed.isEmpty():
            return current


def set_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert; a null label removes."""
    rest = labels.join(changes.select("net_id", "node"), ["net_id", "node"], "left_anti").select("net_id", "node", "label")
    return rest.union(changes.where("label is not null").select("net_id", "node", "label"))


def move_labels(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (net_id, node, target)."""
    return labels.join(moves, ["net_id", "node"], "left").select("net_id", F.coalesce("target", "node").alias("node"), "label")


def unzip(edges: DataFrame) -> DataFrame:
    """Multi-labelled tree of all root paths: (net_id, path, node); a path is a node, its prefix the parent."""
    from .recursion import all_paths

    return all_paths(edges).select("net_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "node")
