"""Transitive queries: reachability, closure, layers, connectivity, paths.

General networks: a loop of joins with a frontier that is anti-joined with what was seen;
each round is written to the shared folder.  Trees: pointer doubling, log2(depth) rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop


def rounds(edges: DataFrame, doubling: bool = False) -> Iterator[int]:
    """0, 1, 2, ...; raises once there were more rounds than an acyclic network needs.

    The size of the largest network is looked up only by loops that go deep.
    """
    k, limit = 0, None
    while limit is None or k <= limit:
        yield k
        k += 1
        if k == (6 if doubling else 8):
            size = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("net_id").count().agg(F.max("count")).first()[0] or 0
            limit = size.bit_length() + 1 if doubling else size + 1
    raise ValueError("a network has a cycle")


def reach(edges: DataFrame, seeds: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """(net_id, node): what is reachable from ``seeds``, them included, never entering ``forbidden``."""
    step = edges.select("net_id", F.col("src").alias("node"), "dst")
    if forbidden is not None:
        step = step.join(forbidden.select("net_id", F.col("node").alias("dst")), ["net_id", "dst"], "left_anti")
        seeds = seeds.join(forbidden.select("net_id", "node"), ["net_id", "node"], "left_anti")
    seen = frontier = cut(seeds.select("net_id", "node").distinct())
    while True:
        found = frontier.join(step, ["net_id", "node"]).select("net_id", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["net_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def _one_parent(edges: DataFrame) -> None:
    """Doubling needs it: with two parents the rows would multiply in every round."""
    if not edges.groupBy("net_id", "dst").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("not a tree: a node has several parents")


def tree_closure(edges: DataFrame) -> DataFrame:
    """(net_id, node, anc, dist) of trees, every node its own ancestor, by pointer doubling.  A cycle or a second parent is an error."""
    _one_parent(edges)
    jump = cut(edges.select("net_id", F.col("dst").alias("node"), F.col("src").alias("anc"), F.lit(1).alias("dist")))
    all_nodes = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    near = cut(all_nodes.select("net_id", "node", F.col("node").alias("anc"), F.lit(0).alias("dist")))
    # near: ancestors closer than 2^k; jump: the one at 2^k exactly.
    for _ in rounds(edges, doubling=True):
        if jump.isEmpty():
            break
        far = jump.withColumnRenamed("anc", "via").withColumnRenamed("dist", "d0")
        up = near.select("net_id", F.col("node").alias("via"), "anc", "dist")
        near_next = cut(near.union(far.join(up, ["net_id", "via"]).select("net_id", "node", "anc", F.col("d0") + F.col("dist"))))
        on = jump.select("net_id", F.col("node").alias("via"), "anc", F.col("dist").alias("d1"))
        jump = cut(far.join(on, ["net_id", "via"]).select("net_id", "node", "anc", (F.col("d0") + F.col("d1")).alias("dist")))
        drop(near)
        near = near_next
    return near


def tree_fold(edges: DataFrame, values: DataFrame, down: dict[str, str], up: tuple[str, ...] = ()) -> DataFrame:
    """``values`` (net_id, node, columns) of all nodes of trees, folded in log2(depth) rounds of as many rows as nodes.

    Columns of ``down`` become the sum, min or max over a node's subtree; those of ``up`` the sum
    over the node and its ancestors.  With the ancestor 2^k above at hand, and folds over what is
    nearer, a round joins both to folds over what is nearer than 2^(k+1).  A cycle or a second parent is an error.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    _one_parent(edges)
    parents = edges.select("net_id", F.col("dst").alias("node"), F.col("src").alias("_p"))
    state = cut(values.select("net_id", "node", *down, *up).join(parents, ["net_id", "node"], "left"))
    for _ in rounds(edges, doubling=True):
        if state.where("_p is not null").isEmpty():
            break
        above = state.select("net_id", F.col("node").alias("_p"), F.col("_p").alias("_p2"), *[F.col(c).alias(f"_u_{c}") for c in up])
        joined = state.join(above, ["net_id", "_p"], "left")
        if down:
            below = state.where("_p is not null").groupBy("net_id", F.col("_p").alias("node")).agg(*[fold[f](c).alias(f"_d_{c}") for c, f in down.items()])
            joined = joined.join(below, ["net_id", "node"], "left")
        before, state = state, cut(joined.select(
            "net_id", "node", F.col("_p2").alias("_p"), *[both[f](F.col(c), F.col(f"_d_{c}")).alias(c) for c, f in down.items()],
            *[(F.col(c) + F.coalesce(f"_u_{c}", F.lit(0))).alias(c) for c in up]))
        drop(before)
    return state.drop("_p")


def tree_facts(edges: DataFrame) -> DataFrame:
    """(net_id, node, size, depth) of trees."""
    heads = edges.select("net_id", F.col("dst").alias("node"), F.lit(1).cast("long").alias("depth"))
    roots = edges.select("net_id", F.col("src").alias("node")).distinct().join(heads.select("net_id", "node"), ["net_id", "node"], "left_anti").withColumn("depth", F.lit(0).cast("long"))
    return tree_fold(edges, heads.union(roots).withColumn("size", F.lit(1).cast("long")), {"size": "sum"}, ("depth",))


def closure(edges: DataFrame) -> DataFrame:
    """(net_id, node, anc) of any acyclic network, by a deduplicating loop."""
    up = edges.select("net_id", F.col("dst").alias("via"), F.col("src").alias("anc"))
    all_nodes = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    seen = frontier = cut(all_nodes.select("net_id", "node", F.col("node").alias("anc")))
    while True:
        found = frontier.withColumnRenamed("anc", "via").join(up, ["net_id", "via"]).select("net_id", "node", "anc").distinct()
        frontier = cut(found.join(seen, ["net_id", "node", "anc"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def connected(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(net_id, node, comp): undirected components, comp the smallest node, by min-label spread with shortcuts."""
    both = cut(edges.select("net_id", F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("net_id", "dst", "src")))
    label = cut(all_nodes.select("net_id", "node", F.col("node").alias("comp")))
    while True:
        offers = both.join(label.select("net_id", F.col("node").alias("other"), "comp"), ["net_id", "other"]).groupBy("net_id", "node").agg(F.min("comp").alias("offer"))
        new = label.join(offers, ["net_id", "node"], "left").select("net_id", "node", F.least("comp", F.coalesce("offer", "comp")).alias("comp"), F.col("comp").alias("old"))
        hop = label.select("net_id", F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = cut(new.join(hop, ["net_id", "comp"]).select("net_id", "node", F.least("comp", "next").alias("comp"), "old"))
        if new.where("comp <> old").isEmpty():
            return new.select("net_id", "node", "comp")
        label = new.select("net_id", "node", "comp")


def component_sizes(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(net_id, comp, n_nodes)."""
    return connected(edges, all_nodes).groupBy("net_id", "comp").agg(F.count("*").alias("n_nodes"))


def layers(edges: DataFrame) -> DataFrame:
    """(net_id, node, layer) by peeling sources; nodes on or below cycles get none."""
    rest = cut(edges.select("net_id", "src", "dst"))
    left = cut(edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).distinct())
    out, k = [], 0
    while True:
        top = cut(left.join(rest.select("net_id", F.col("dst").alias("node")), ["net_id", "node"], "left_anti").select("net_id", "node", F.lit(k).alias("layer")))
        if top.isEmpty():
            break
        out.append(top)
        gone = top.select("net_id", "node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "src"), ["net_id", "src"], "left_anti").select("net_id", "src", "dst"))
        left = cut(left.join(gone, ["net_id", "node"], "left_anti"))
        k += 1
    found = left.select("net_id", "node", F.lit(None).cast("int").alias("layer")).limit(0)
    for x in out:
        found = found.union(x)
    return found


def _roots(edges: DataFrame) -> DataFrame:
    return edges.select("net_id", F.col("src").alias("node")).distinct().join(edges.select("net_id", F.col("dst").alias("node")), ["net_id", "node"], "left_anti")


def walks(edges: DataFrame) -> DataFrame:
    """(net_id, node, length, n_paths): paths from the roots by length; a round per length, nothing written twice.  A cycle is an error."""
    step = cut(edges.select("net_id", F.col("src").alias("node"), "dst"))
    frontier = cut(_roots(edges).select("net_id", "node", F.lit(0).alias("length"), F.lit(1).cast("long").alias("n_paths")))
    out = frontier
    for k in rounds(edges):
        frontier = cut(frontier.join(step, ["net_id", "node"]).groupBy("net_id", F.col("dst").alias("node")).agg(F.lit(k + 1).alias("length"), F.sum("n_paths").alias("n_paths")))
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out


def path_counts(edges: DataFrame) -> DataFrame:
    """(net_id, node, n_paths): paths from the roots."""
    return walks(edges).groupBy("net_id", "node").agg(F.sum("n_paths").alias("n_paths"))


def longest_layers(edges: DataFrame) -> DataFrame:
    """(net_id, node, layer): length of the longest path from a root."""
    return walks(edges).groupBy("net_id", "node").agg(F.max("length").alias("layer"))


def all_paths(edges: DataFrame) -> DataFrame:
    """(net_id, node, path): every root path as an array (exponential in general; use where paths are the answer)."""
    step = edges.select("net_id", F.col("src").alias("node"), "dst")
    frontier = cut(_roots(edges).select("net_id", "node", F.array("node").alias("path")))
    out = frontier
    for _ in rounds(edges):
        frontier = cut(frontier.join(step, ["net_id", "node"]).select("net_id", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if frontier.isEmpty():
            return out
        out = out.union(frontier)


def edges_below(edges: DataFrame, seeds: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Arcs whose tail is reachable from ``seeds`` and whose head isn't forbidden."""
    tails = reach(edges, seeds, forbidden)
    found = edges.join(tails.withColumnRenamed("node", "src"), ["net_id", "src"], "left_semi")
    if forbidden is not None:
        found = found.join(forbidden.select("net_id", F.col("node").alias("dst")), ["net_id", "dst"], "left_anti")
    return found.select("net_id", "src", "dst")


def lowest_tree_ancestors(edges: DataFrame, out_degree: DataFrame) -> DataFrame:
    """(net_id, node, anc): nearest ancestors whose out-degree isn't 1."""
    deg = out_degree.select("net_id", F.col("node").alias("anc"), "outdeg")
    up = edges.select("net_id", F.col("dst").alias("via"), F.col("src").alias("anc"))
    frontier = cut(edges.select("net_id", F.col("dst").alias("node"), F.col("src").alias("anc")).join(deg, ["net_id", "anc"]))
    done = frontier.where("outdeg <> 1").select("net_id", "node", "anc")
    for _ in rounds(edges):
        walk = frontier.where("outdeg = 1").select("net_id", "node", F.col("anc").alias("via"))
        frontier = cut(walk.join(up, ["net_id", "via"]).select("net_id", "node", "anc").distinct().join(deg, ["net_id", "anc"]))
        if frontier.isEmpty():
            return done.distinct()
        done = done.union(frontier.where("outdeg <> 1").select("net_id", "node", "anc"))
