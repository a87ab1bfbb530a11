"""The data model: collections of networks as tables keyed by ``net_id``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "net_id long, node long"
EDGES = "net_id long, src long, dst long, length double"
LABELS = "net_id long, node long, label string"


@dataclass
class Network:
    """A collection of networks.  ``nodes`` holds isolated nodes too."""

    edges: DataFrame
    labels: DataFrame
    nodes: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, labels: DataFrame | None = None, nodes: DataFrame | None = None) -> Network:
        """Arcs are a set by (net_id, src, dst); of parallel arcs the smallest length stays."""
        if "length" not in edges.columns:
            edges = edges.withColumn("length", F.lit(None).cast("double"))
        spark = edges.sparkSession
        edges = edges.groupBy("net_id", "src", "dst").agg(F.min("length").alias("length"))
        found = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node"))
        nodes = (found if nodes is None else found.union(nodes.select("net_id", "node"))).distinct()
        return cls(edges, labels if labels is not None else spark.createDataFrame([], LABELS), nodes)


def validate(net: Network, tree: bool = False) -> DataFrame:
    """Violations ``(net_id, rule, node)``: several roots, no root, cycle, reticulation in a tree, repeated label."""
    from ..operators.basic import degree
    from ..operators.structure import cyclic_nodes

    deg = degree(net.edges, net.nodes)
    roots = deg.where("indeg = 0").groupBy("net_id").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    out = roots.where("n > 1").select("net_id", F.lit("several roots").alias("rule"), "node")
    nets = net.nodes.select("net_id").distinct()
    out = out.union(nets.join(roots, "net_id", "left_anti").select("net_id", F.lit("no root"), F.lit(None).cast("long")))
    out = out.union(cyclic_nodes(net.edges).groupBy("net_id").agg(F.min("node").alias("node")).select("net_id", F.lit("cycle"), "node"))
    if tree:
        out = out.union(deg.where("indeg > 1").select("net_id", F.lit("reticulation in a tree"), "node"))
    repeated = net.labels.where("label <> ''").groupBy("net_id", "label").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n > 1")
    return out.union(repeated.select("net_id", F.lit("repeated label"), "node"))
