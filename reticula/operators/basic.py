"""Nodes, arcs, degrees, node classes, neighbour joins and label joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def degree(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(net_id, node, indeg, outdeg) in one aggregation with map-side combine."""
    ends = edges.select("net_id", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("net_id", "e.node", "e.i", "e.o")
    if isolated is not None:
        ends = ends.union(isolated.select("net_id", "node", F.lit(0), F.lit(0)))
    return ends.groupBy("net_id", "node").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))


def node_type() -> Column:
    """reti wins over leaf; the rest are tree nodes."""
    return F.when(F.col("indeg") > 1, "reti").when(F.col("outdeg") == 0, "leaf").otherwise("tree")


def is_root() -> Column:
    return F.col("indeg") == 0


def is_leaf() -> Column:
    return F.col("outdeg") == 0


def is_reticulation() -> Column:
    return F.col("indeg") >= 2


def is_tree_node(network: bool = True) -> Column:
    """In a network: in-degree exactly 1 (so not the root); in a tree: any inner node."""
    return F.col("indeg") == 1 if network else F.col("outdeg") > 0


def is_inner_tree_node() -> Column:
    return (F.col("indeg") == 1) & (F.col("outdeg") > 0)


def is_suppressible() -> Column:
    return (F.col("indeg") == 1) & (F.col("outdeg") == 1)


def is_junction() -> Column:
    return (F.col("indeg") > 1) & (F.col("outdeg") > 1)


def parents(edges: DataFrame) -> DataFrame:
    """(net_id, node, parent): the smallest parent; the root is its own."""
    up = edges.groupBy("net_id", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    roots = edges.select("net_id", F.col("src").alias("node")).distinct().join(up, ["net_id", "node"], "left_anti")
    return up.union(roots.select("net_id", "node", F.col("node").alias("parent")))


def out_edges(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Arcs whose tail is in ``of`` (net_id, node)."""
    return edges.join(of.select("net_id", F.col("node").alias("src")), ["net_id", "src"], "left_semi")


def in_edges(edges: DataFrame, of: DataFrame) -> DataFrame:
    return edges.join(of.select("net_id", F.col("node").alias("dst")), ["net_id", "dst"], "left_semi")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("net_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "length")


def incident_with(x: Column) -> Column:
    return (F.col("src") == x) | (F.col("dst") == x)


def is_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (net_id, a, b) with ``is_edge`` (a->b) and ``adjacent`` (an arc either way)."""
    e = edges.select("net_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    forth = pairs.select("net_id", "a", "b").join(e.withColumn("_f", F.lit(True)), ["net_id", "a", "b"], "left")
    back = e.select("net_id", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_b"))
    both = forth.join(back, ["net_id", "a", "b"], "left")
    return both.select("net_id", "a", "b", F.col("_f").isNotNull().alias("is_edge"), (F.col("_f").isNotNull() | F.col("_b").isNotNull()).alias("adjacent"))


def has_node(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (net_id, node) with ``has_node``."""
    own = nodes(edges).withColumn("_own", F.lit(True))
    return asked.select("net_id", "node").join(own, ["net_id", "node"], "left").select("net_id", "node", F.col("_own").isNotNull().alias("has_node"))


def emptiness(nets: DataFrame, all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nets`` (net_id) with ``empty`` (no nodes) and ``edgeless``."""
    n = all_nodes.select("net_id").distinct().withColumn("_n", F.lit(True))
    e = edges.select("net_id").distinct().withColumn("_e", F.lit(True))
    return nets.select("net_id").distinct().join(n, "net_id", "left").join(e, "net_id", "left").select(
        "net_id", (F.col("_n").isNull() & F.col("_e").isNull()).alias("empty"), F.col("_e").isNull().alias("edgeless"))


def common_parents(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (net_id, a, b) with the number of common parents and the smallest (null if none): by two lookups, never by listing siblings."""
    up = lambda c: edges.select("net_id", F.col("dst").alias(c), F.col("src").alias("parent"))
    found = pairs.select("net_id", "a", "b").join(up("a"), ["net_id", "a"]).join(up("b"), ["net_id", "b", "parent"], "left_semi")
    n = found.groupBy("net_id", "a", "b").agg(F.count("*").alias("n_common"), F.min("parent").alias("common_parent"))
    return pairs.select("net_id", "a", "b").join(n, ["net_id", "a", "b"], "left").select("net_id", "a", "b", F.coalesce("n_common", F.lit(0)).alias("n_common"), "common_parent")


def with_label(df: DataFrame, labels: DataFrame, on: str = "node", name: str = "label") -> DataFrame:
    """``df`` with the label of column ``on``; '' if it has none."""
    right = labels.select("net_id", F.col("node").alias(on), F.col("label").alias(name))
    return df.join(right, ["net_id", on], "left").withColumn(name, F.coalesce(name, F.lit("")))


def labelled_branches(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Every arc with both labels and its length (0 if absent)."""
    both = with_label(with_label(edges, labels, "src", "src_label"), labels, "dst", "dst_label")
    return both.select("net_id", "src", "dst", "src_label", "dst_label", F.coalesce("length", F.lit(0.0)).alias("length"))


def tree_summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node its label and its neighbours as sorted, comma-separated text."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    ends = edges.select("net_id", F.col("src").alias("node"), F.col("dst").alias("c"), F.lit(None).cast("long").alias("p")).union(
        edges.select("net_id", "dst", F.lit(None).cast("long"), "src"))
    return with_label(ends.groupBy("net_id", "node").agg(listed("p").alias("parents"), listed("c").alias("children")), labels)


def is_tree(edges: DataFrame) -> DataFrame:
    """(net_id, is_tree): arcs = nodes - 1."""
    n = nodes(edges).groupBy("net_id").agg(F.count("*").alias("n"))
    return edges.groupBy("net_id").agg(F.count("*").alias("m")).join(n, "net_id").select("net_id", (F.col("m") == F.col("n") - 1).alias("is_tree"))


def is_multi_labelled(labels: DataFrame, key: str = "net_id") -> DataFrame:
    per = labels.groupBy(key, "label").agg(F.count("*").alias("n"))
    return per.groupBy(key).agg((F.max("n") > 1).alias("multi_labelled"))


def siblings(edges: DataFrame) -> DataFrame:
    """Pairs (a < b) that share a parent, with the number of common parents and the smallest."""
    e = edges.select("net_id", "src", "dst")
    pairs = e.withColumnRenamed("dst", "a").join(e.withColumnRenamed("dst", "b"), ["net_id", "src"]).where("a < b")
    return pairs.groupBy("net_id", "a", "b").agg(F.count("*").alias("n_common"), F.min("src").alias("common_parent"))


def label_matching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two labellings on non-empty labels: (label, n_a, n_b, node_a, node_b)."""
    side = lambda df, s: df.where("label <> ''").groupBy("label").agg(F.count("*").alias(f"n_{s}"), F.min("node").alias(f"node_{s}"))
    joined = side(a, "a").join(side(b, "b"), "label", "full")
    return joined.select("label", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "node_a", "node_b")


def leaf_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(degree(edges).where(is_leaf()).select("net_id", "node"), ["net_id", "node"], "left_semi")


def label_clean_up(host: DataFrame, guest: DataFrame) -> DataFrame:
    """Labels of one side only: guest-only ones rule containment out, host-only ones are pruned."""
    g = guest.select("label").distinct().join(host.select("label").distinct(), "label", "left_anti")
    h = host.select("label").distinct().join(guest.select("label").distinct(), "label", "left_anti")
    return g.select("label", F.lit("guest only").alias("side")).union(h.select("label", F.lit("host only")))


def triangles(edges: DataFrame) -> DataFrame:
    """x->y, y->z, x->z with out(z) = 1, out(y) <= 2, out(x) = 2."""
    out = degree(edges).select("net_id", "node", "outdeg")
    e = edges.select("net_id", "src", "dst")
    of = lambda df, c: df.join(out.select("net_id", F.col("node").alias(c), F.col("outdeg").alias(f"out_{c}")), ["net_id", c])
    xy = e.toDF("net_id", "x", "y")
    yz = e.toDF("net_id", "y", "z")
    xz = e.toDF("net_id", "x", "z")
    found = xy.join(yz, ["net_id", "y"]).join(xz, ["net_id", "x", "z"])
    return of(of(of(found, "x"), "y"), "z").where("out_z = 1 and out_y <= 2 and out_x = 2").select("net_id", "x", "y", "z")


def unary_chains(edges: DataFrame) -> DataFrame:
    """Arcs whose ends both have out-degree 1 (chains of reticulations or suppressible nodes)."""
    one = degree(edges).where("outdeg = 1").select("net_id", "node")
    return edges.select("net_id", "src", "dst").join(one.withColumnRenamed("node", "src"), ["net_id", "src"], "left_semi").join(
        one.withColumnRenamed("node", "dst"), ["net_id", "dst"], "left_semi").select("net_id", "src", "dst")


def cherries(edges: DataFrame) -> DataFrame:
    """Nodes all of whose children are leaves, at least two: (net_id, node, n_leaves)."""
    deg = degree(edges).select("net_id", F.col("node").alias("dst"), "outdeg")
    per = edges.join(deg, ["net_id", "dst"]).groupBy("net_id", F.col("src").alias("node")).agg(F.count("*").alias("n_leaves"), F.max("outdeg").alias("m"))
    return per.where("m = 0 and n_leaves >= 2").select("net_id", "node", "n_leaves")


def common_cherries(a: DataFrame, labels_a: DataFrame, b: DataFrame, labels_b: DataFrame) -> DataFrame:
    """(net_id, labels): cherries that both networks of a net_id have, matched by their sorted leaf labels."""
    def of(edges: DataFrame, labels: DataFrame) -> DataFrame:
        leaves = edges.join(cherries(edges).select("net_id", F.col("node").alias("src")), ["net_id", "src"], "left_semi").select("net_id", "src", F.col("dst").alias("node"))
        named = leaves.join(labels.where("label <> ''").select("net_id", "node", "label"), ["net_id", "node"])
        return named.groupBy("net_id", "src").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels")).select("net_id", "labels").distinct()

    return of(a, labels_a).join(of(b, labels_b), ["net_id", "labels"], "left_semi")
