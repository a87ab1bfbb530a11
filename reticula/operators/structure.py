"""Cycles, bridges, blocks, tree components, dominators, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .basic import degree
from .order import orders
from .recursion import closure, connected, layers, longest_layers, rounds, tree_closure, tree_fold


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(net_id, node): nodes that peeling sources never frees (on a cycle, or below one)."""
    every = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return every.join(layers(edges).select("net_id", "node"), ["net_id", "node"], "left_anti")


def bridges(edges: DataFrame) -> DataFrame:
    """(net_id, src, dst): arcs whose removal disconnects the undirected network.

    Spanning tree by smallest parent, pre-order intervals, then for each subtree the lowest
    and highest pre-order number next to it by a non-tree arc (Tarjan 1974).
    """
    e = cut(edges.select("net_id", "src", "dst"))
    tree = cut(e.groupBy("net_id", "dst").agg(F.min("src").alias("src")).select("net_id", "src", "dst"))
    o = cut(orders(tree).select("net_id", "node", "pre", "size"))
    rest = e.join(tree, ["net_id", "src", "dst"], "left_anti")
    ends = rest.select("net_id", F.col("src").alias("node"), F.col("dst").alias("other")).union(rest.select("net_id", "dst", "src"))
    seen = ends.join(o.select("net_id", F.col("node").alias("other"), F.col("pre").alias("p")), ["net_id", "other"]).select("net_id", "node", "p")
    seen = seen.groupBy("net_id", "node").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    sub = tree_fold(tree, o.select("net_id", "node").join(seen, ["net_id", "node"], "left"), {"lo": "min", "hi": "max"})
    facts = o.join(sub, ["net_id", "node"], "left")
    clear = (F.coalesce("lo", "pre") >= F.col("pre")) & (F.coalesce("hi", "pre") < F.col("pre") + F.col("size"))
    return tree.join(facts.where(clear).select("net_id", F.col("node").alias("dst")), ["net_id", "dst"]).select("net_id", "src", "dst")


def blocks(edges: DataFrame) -> DataFrame:
    """(net_id, node, block): bridge-blocks (2-edge-connected components); block is the smallest node."""
    rest = edges.select("net_id", "src", "dst").join(bridges(edges), ["net_id", "src", "dst"], "left_anti")
    every = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return connected(rest, every).select("net_id", "node", F.col("comp").alias("block"))


def tree_components(edges: DataFrame) -> DataFrame:
    """(net_id, node, comp): maximal pieces without reticulations among inner nodes; comp is the topmost node.

    The root starts a component, and so does an inner tree node below a reticulation.
    """
    deg = cut(degree(edges))
    inner = deg.where("outdeg > 0 and indeg <= 1").select("net_id", "node")
    arcs = (edges.select("net_id", "src", "dst").join(inner.withColumnRenamed("node", "src"), ["net_id", "src"], "left_semi")
            .join(inner.withColumnRenamed("node", "dst"), ["net_id", "dst"], "left_semi").select("net_id", "src", "dst"))
    arcs = cut(arcs)
    heads = arcs.select("net_id", F.col("dst").alias("node"))
    tops = inner.join(heads, ["net_id", "node"], "left_anti").select("net_id", "node", F.col("node").alias("comp"))
    up = tree_closure(arcs)
    below = up.join(tops.select("net_id", F.col("node").alias("anc"), "comp"), ["net_id", "anc"]).select("net_id", "node", "comp")
    return below.union(tops).distinct()


def component_facts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component DAG (net_id, src, dst) and visible leaves (net_id, comp, leaf).

    From each component root, and each leaf, walk up through reticulations to the components
    above; a leaf is visible from a component if every way up ends in it.
    """
    comp = cut(tree_components(edges))
    deg = cut(degree(edges))
    up = edges.select("net_id", F.col("dst").alias("via"), F.col("src").alias("up"))
    roots = comp.where("node = comp").select("net_id", "node", F.lit(True).alias("is_root"))
    leaves = deg.where("outdeg = 0 and indeg <= 1").select("net_id", "node", F.lit(False).alias("is_root"))
    frontier = cut(roots.union(leaves).select("net_id", "node", "is_root", F.col("node").alias("via")))
    met = None
    for _ in rounds(edges):
        step = frontier.join(up, ["net_id", "via"]).select("net_id", "node", "is_root", F.col("up").alias("via")).distinct()
        hit = cut(step.join(comp.select("net_id", F.col("node").alias("via"), "comp"), ["net_id", "via"], "left"))
        part = hit.where("comp is not null").select("net_id", "node", "is_root", "comp")
        met = part if met is None else met.union(part)
        frontier = hit.where("comp is null").select("net_id", "node", "is_root", "via")
        if frontier.isEmpty():
            break
    met = cut(met.distinct())
    dag = met.where("is_root").select("net_id", F.col("comp").alias("src"), F.col("node").alias("dst"))
    agreed = met.where("not is_root").groupBy("net_id", "node").agg(F.min("comp").alias("comp"), F.max("comp").alias("other")).where("comp = other")
    return dag, agreed.groupBy("net_id", "comp").agg(F.min("node").alias("leaf"))


def dominators(edges: DataFrame) -> DataFrame:
    """(net_id, node, dom): every dominator of every node, itself included, layer by layer:
    a node's are what dominates all of its parents."""
    layer = cut(longest_layers(edges))
    deg = degree(edges).select("net_id", "node", "indeg")
    depth = layer.agg(F.max("layer")).first()[0] or 0
    into = cut(edges.join(layer.join(deg, ["net_id", "node"]).select("net_id", F.col("node").alias("dst"), "layer", "indeg"), ["net_id", "dst"]).select("net_id", "src", "dst", "layer", "indeg"), by="layer")
    own = layer.select("net_id", "node", F.col("node").alias("dom"), "layer")
    dom = cut(own.where("layer = 0").drop("layer"))
    for k in range(1, depth + 1):
        step = into.where(F.col("layer") == k)
        shared = step.join(dom.withColumnRenamed("node", "src"), ["net_id", "src"]).groupBy("net_id", "dst", "dom").agg(F.count("*").alias("n"), F.max("indeg").alias("d")).where("n = d")
        dom = dom.union(cut(shared.select("net_id", F.col("dst").alias("node"), "dom").union(own.where(F.col("layer") == k).drop("layer"))))
    return dom


def immediate_dominators(dom: DataFrame) -> DataFrame:
    """(net_id, node, idom): the strict dominator with most dominators of its own."""
    n = dom.groupBy("net_id", "node").agg(F.count("*").alias("n"))
    strict = dom.where("node <> dom").join(n.select("net_id", F.col("node").alias("dom"), "n"), ["net_id", "dom"])
    return strict.groupBy("net_id", "node").agg(F.max_by("dom", "n").alias("idom"))


def leaf_stability(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(net_id, node, leaf): the smallest leaf that every root path to passes the node."""
    leaves = degree(edges).where("outdeg = 0").select("net_id", F.col("node").alias("leaf"))
    return dom.withColumnRenamed("node", "leaf").join(leaves, ["net_id", "leaf"], "left_semi").groupBy("net_id", F.col("dom").alias("node")).agg(F.min("leaf").alias("leaf"))


def ancestors(edges: DataFrame) -> DataFrame:
    return closure(edges)


def _climb(edges: DataFrame, comp: DataFrame, start: DataFrame) -> DataFrame:
    """(net_id, node, comp, n_paths): from ``start`` (net_id, node) up to the first nodes of components, and by how many ways."""
    up = cut(edges.select("net_id", F.col("dst").alias("via"), F.col("src").alias("up")))
    frontier = cut(start.select("net_id", "node", F.col("node").alias("via"), F.lit(1).cast("long").alias("n")))
    met = None
    for _ in rounds(edges):
        step = frontier.join(up, ["net_id", "via"]).groupBy("net_id", "node", F.col("up").alias("via")).agg(F.sum("n").alias("n"))
        hit = cut(step.join(comp.select("net_id", F.col("node").alias("via"), "comp"), ["net_id", "via"], "left"))
        part = hit.where("comp is not null").select("net_id", "node", "comp", "n")
        met = part if met is None else met.union(part)
        frontier = hit.where("comp is null").select("net_id", "node", "via", "n")
        if frontier.isEmpty():
            break
    return met.groupBy("net_id", "node", "comp").agg(F.sum("n").alias("n_paths"))


def component_paths(edges: DataFrame) -> DataFrame:
    """(net_id, src, dst, n_paths): paths from the top of each tree component to the tops below it.

    A component is a tree, so paths multiply only on the way through reticulations: arcs of the
    component DAG carry their number of ways, and longer paths are counted over that DAG.
    """
    comp = cut(tree_components(edges))
    arcs = cut(_climb(edges, comp, comp.where("node = comp")).select("net_id", F.col("comp").alias("src"), F.col("node").alias("dst"), "n_paths"))
    frontier = out = arcs
    step = arcs.select("net_id", F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("n_paths").alias("n"))
    for _ in rounds(arcs):
        frontier = cut(frontier.join(step, ["net_id", "dst"]).groupBy("net_id", "src", F.col("next").alias("dst")).agg(F.sum(F.col("n_paths") * F.col("n")).alias("n_paths")))
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out.groupBy("net_id", "src", "dst").agg(F.sum("n_paths").alias("n_paths"))


def eligible_components(edges: DataFrame) -> DataFrame:
    """(net_id, comp, half_eligible, eligible): half-eligible if a single path leads to each component below; eligible if a leaf sees it too."""
    tops = cut(tree_components(edges)).where("node = comp").select("net_id", "comp")
    most = component_paths(edges).groupBy("net_id", F.col("src").alias("comp")).agg(F.max("n_paths").alias("most"))
    seen = component_facts(edges)[1].select("net_id", "comp", F.lit(True).alias("seen"))
    half = F.coalesce(F.col("most") == 1, F.lit(True))
    return tops.join(most, ["net_id", "comp"], "left").join(seen, ["net_id", "comp"], "left").select(
        "net_id", "comp", half.alias("half_eligible"), (half & F.coalesce("seen", F.lit(False))).alias("eligible"))


def branch_counts(edges: DataFrame) -> DataFrame:
    """(net_id, node, n_none, n_inner, n_leaf, candidate, best) of reticulations, by what their parents see.

    A node sees a component if it is in it or if all its ways up first meet that one.  Counted
    are the parents that see none, one with components below it, and one without.  Reticulations
    above a single leaf that see none themselves are candidates to branch at; the best of a
    network has the least counts, in that order, then the least id.
    """
    edges = cut(edges.select("net_id", "src", "dst"))
    comp, deg = cut(tree_components(edges)), cut(degree(edges))
    outside = deg.select("net_id", "node").join(comp, ["net_id", "node"], "left_anti")
    met = cut(_climb(edges, comp, outside))
    agreed = met.groupBy("net_id", "node").agg(F.min("comp").alias("comp"), F.max("comp").alias("other")).where("comp = other").select("net_id", "node", "comp")
    above = _climb(edges, comp, comp.where("node = comp")).select("net_id", "comp").distinct().withColumn("inner", F.lit(True))
    sees = cut(comp.select("net_id", "node", "comp").union(agreed).join(above, ["net_id", "comp"], "left").select("net_id", "node", "comp", F.coalesce("inner", F.lit(False)).alias("inner")))
    reti = deg.where("indeg > 1").select("net_id", F.col("node").alias("dst"), "outdeg")
    parents = edges.join(reti, ["net_id", "dst"]).join(sees.select("net_id", F.col("node").alias("src"), "inner"), ["net_id", "src"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = parents.groupBy("net_id", F.col("dst").alias("node")).agg(n(F.col("inner").isNull()).alias("n_none"), n(F.col("inner")).alias("n_inner"), n(~F.col("inner")).alias("n_leaf"))
    tips = deg.where("indeg = 1 and outdeg = 0").select("net_id", F.col("node").alias("dst"))
    single = edges.join(tips, ["net_id", "dst"], "left_semi").join(deg.where("indeg > 1 and outdeg = 1").select("net_id", F.col("node").alias("src")), ["net_id", "src"], "left_semi")
    able = single.select("net_id", F.col("src").alias("node")).join(sees, ["net_id", "node"], "left_anti").withColumn("candidate", F.lit(True))
    counts = cut(counts.join(able, ["net_id", "node"], "left").withColumn("candidate", F.coalesce("candidate", F.lit(False))))
    best = counts.where("candidate").groupBy("net_id").agg(F.min_by("node", F.struct("n_none", "n_inner", "n_leaf", "node")).alias("best"))
    return counts.join(best, "net_id", "left").select("net_id", "node", "n_none", "n_inner", "n_leaf", "candidate", F.coalesce(F.col("best") == F.col("node"), F.lit(False)).alias("best"))
