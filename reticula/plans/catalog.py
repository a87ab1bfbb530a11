"""The registered queries: operators over the driver's tables seen as networks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import basic, containment, iso, lca, order, recursion, rewrite, scanwidth, sets, structure
from ..sources import fixtures as fx
from ..sources import generate, newick
from .lineage import cut
from .model import Network, validate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


FA, FB, FD, FE, FG, FH = (fx.SQL[k] for k in ("fa", "fb", "fd", "fe", "fg", "fh"))
DEG = """deg AS (SELECT node, sum(i) AS indeg, sum(o) AS outdeg FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {t} UNION ALL SELECT dst, 1, 0 FROM {t}) GROUP BY node)"""
DEGN = """deg AS (SELECT net_id, node, sum(i) AS indeg, sum(o) AS outdeg FROM (SELECT net_id, src AS node, 0 AS i, 1 AS o FROM {t} UNION ALL SELECT net_id, dst, 1, 0 FROM {t}) GROUP BY net_id, node)"""
#: Closure of the geo tree, with distance.
CLOSURE = "up AS (SELECT dst AS node, dst AS anc, 0 AS dist FROM fb UNION ALL SELECT 0, 0, 0 UNION ALL SELECT up.node, fb.src, up.dist + 1 FROM up JOIN fb ON fb.dst = up.anc)"
WALK = "walk AS (SELECT 0::BIGINT AS node, [0::BIGINT] AS path UNION ALL SELECT fb.dst, list_append(walk.path, fb.dst) FROM walk JOIN fb ON fb.src = walk.node)"
ORDERED = "ord AS (SELECT node, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS pre FROM walk), siz AS (SELECT anc AS node, count(*) AS size FROM up GROUP BY anc)"
REACHD = "reach AS (SELECT DISTINCT net_id, src AS x, src AS node FROM fd UNION SELECT net_id, dst, dst FROM fd UNION SELECT r.net_id, r.x, fd.dst FROM reach r JOIN fd ON fd.net_id = r.net_id AND fd.src = r.node)"


# ---- nodes, degrees, classes -------------------------------------------------------------

@query(f"WITH {FA}, {DEG.format(t='fa')} SELECT node, indeg, outdeg FROM deg")
def node_degree(s, d):
    return basic.degree(fx.commerce(s, d)).select("node", "indeg", "outdeg")


@query(f"WITH {FA}, {DEG.format(t='fa')} SELECT indeg, outdeg, count(*) AS n FROM deg GROUP BY indeg, outdeg")
def degree_histogram(s, d):
    return basic.degree(fx.commerce(s, d)).groupBy("indeg", "outdeg").agg(F.count("*").alias("n"))


@query("SELECT p_name AS label, count(*) AS n FROM part GROUP BY p_name")
def label_histogram(s, d):
    return fx.part_tree_labels(s, d).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {FA}, {DEG.format(t='fa')} SELECT node, CASE WHEN indeg > 1 THEN 'reti' WHEN outdeg = 0 THEN 'leaf' ELSE 'tree' END AS kind FROM deg")
def node_types(s, d):
    return basic.degree(fx.commerce(s, d)).select("node", basic.node_type().alias("kind"))


def _class_query(name: str, predicate, sql: str):
    @query(f"WITH {FD}, {DEGN.format(t='fd')} SELECT net_id, node FROM deg WHERE {sql}", name)
    def of_class(s, d):
        return basic.degree(fx.lattices(s, d)).where(predicate()).select("net_id", "node")


for _name, _pred, _sql in (
    ("leaves", basic.is_leaf, "outdeg = 0"), ("reticulations", basic.is_reticulation, "indeg >= 2"), ("roots", basic.is_root, "indeg = 0"),
    ("inner_tree_nodes", basic.is_inner_tree_node, "indeg = 1 AND outdeg > 0"), ("suppressible_nodes", basic.is_suppressible, "indeg = 1 AND outdeg = 1"),
    ("tree_nodes", basic.is_tree_node, "indeg = 1"),
):
    _class_query(_name, _pred, _sql)


def _with_first_region(s, d):
    """Lattices with an arc from every nation to the smallest region of its network: nations of several suppliers become junctions."""
    e = fx.lattices(s, d)
    nations = e.where("src between 2000000000000 and 2999999999999")
    first = nations.groupBy("net_id").agg(F.min("dst").alias("first"))
    return e.union(nations.join(first, "net_id").select("net_id", "src", "first", "length")).distinct()


_FJ = FD + ", fj AS (SELECT * FROM fd UNION SELECT net_id, n, m FROM fd0 JOIN (SELECT net_id, min(r) AS m FROM fd0 GROUP BY net_id) USING (net_id))"


@query(f"""WITH {FD}, p AS (SELECT DISTINCT net_id, s AS a, n AS b FROM (SELECT x.net_id, x.s, y.n FROM fd0 x JOIN fd0 y ON y.net_id = x.net_id)) SELECT p.net_id, a, b, EXISTS (SELECT 1 FROM fd WHERE fd.net_id = p.net_id AND src = a AND dst = b) AS is_edge,
    EXISTS (SELECT 1 FROM fd WHERE fd.net_id = p.net_id AND ((src = a AND dst = b) OR (src = b AND dst = a))) AS adjacent FROM p""")
def edge_tests(s, d):
    """Every supplier against every nation of its network."""
    e = cut(fx.lattices(s, d))
    suppliers = e.where("src = 0").select("net_id", F.col("dst").alias("a"))
    nations = e.where("dst between 2000000000000 and 2999999999999").select("net_id", F.col("dst").alias("b")).distinct()
    return basic.is_edge(e, suppliers.join(nations, "net_id"))


@query(f"WITH {FD}, q AS (SELECT DISTINCT net_id, 1000000000000 + r_regionkey AS node FROM fd, region) SELECT net_id, node, EXISTS (SELECT 1 FROM fd WHERE fd.net_id = q.net_id AND dst = node) AS has_node FROM q")
def has_node(s, d):
    e = cut(fx.lattices(s, d))
    regions = fx.table(s, d, "region").agg(F.collect_list(fx.node(fx.REGION, "r_regionkey")).alias("all"))  # one row of five
    return basic.has_node(e, e.select("net_id").distinct().join(F.broadcast(regions)).select("net_id", F.explode("all").alias("node")))


@query(f"WITH {FD} SELECT o_orderkey AS net_id, o_orderkey NOT IN (SELECT net_id FROM fd) AS empty, o_orderkey NOT IN (SELECT net_id FROM fd) AS edgeless FROM orders")
def empty_networks(s, d):
    e = cut(fx.lattices(s, d))
    return basic.emptiness(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("net_id")), basic.nodes(e), e)


@query(f"""WITH {FD}, p AS (SELECT DISTINCT x.net_id, x.n AS a, y.n AS b FROM fd0 x JOIN fd0 y ON y.net_id = x.net_id AND y.n > x.n), up AS (SELECT DISTINCT net_id, dst, src FROM fd)
    SELECT p.net_id, p.a, p.b, count(y.src) AS n_common, min(y.src) AS common_parent FROM p JOIN up x ON x.net_id = p.net_id AND x.dst = p.a LEFT JOIN up y ON y.net_id = p.net_id AND y.dst = p.b AND y.src = x.src GROUP BY 1, 2, 3""")
def common_parents(s, d):
    e = cut(fx.lattices(s, d))
    nations = e.where("dst between 2000000000000 and 2999999999999").select("net_id", "dst").distinct()
    pairs = nations.select("net_id", F.col("dst").alias("a")).join(nations.select("net_id", F.col("dst").alias("b")), "net_id").where("a < b")
    return basic.common_parents(e, pairs)


@query("""WITH c AS (SELECT user_id, ts::DATE AS day, string_agg(event_type, ',' ORDER BY event_type) AS labels, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id, labels FROM c WHERE n >= 2)
    SELECT x.user_id AS net_id, x.labels FROM u x JOIN u y ON y.user_id = x.user_id + 1 AND y.labels = x.labels""")
def common_cherries(s, d):
    """Cherries of each user's tree that the next user's tree has, too."""
    e, n = fx.event_trees(s, d)
    shift = lambda df: df.withColumn("net_id", F.col("net_id") - 1)
    return basic.common_cherries(e, n, shift(e), shift(n))


@query(f"WITH {_FJ}, {DEGN.format(t='fj')} SELECT net_id, node FROM deg WHERE indeg > 1 AND outdeg > 1")
def junctions(s, d):
    return basic.degree(_with_first_region(s, d)).where(basic.is_junction()).select("net_id", "node")


@query(f"WITH {FD} SELECT net_id, node FROM (SELECT net_id, src AS node FROM fd UNION SELECT net_id, dst FROM fd)")
def all_nodes(s, d):
    return basic.nodes(fx.lattices(s, d))


@query(f"WITH {FA} SELECT count(DISTINCT node) AS n_nodes, (SELECT count(*) FROM fa) AS n_edges FROM (SELECT src AS node FROM fa UNION ALL SELECT dst FROM fa)")
def network_size(s, d):
    e = fx.commerce(s, d)
    return basic.nodes(e).groupBy("net_id").agg(F.count("*").alias("n_nodes")).join(e.groupBy("net_id").agg(F.count("*").alias("n_edges")), "net_id").select("n_nodes", "n_edges")


@query(f"WITH {FA} SELECT src, dst, 'out' AS side FROM fa WHERE src BETWEEN 2000000000000 AND 2999999999999 UNION ALL SELECT src, dst, 'in' FROM fa WHERE dst BETWEEN 2000000000000 AND 2999999999999")
def in_out_edges(s, d):
    e = fx.commerce(s, d)
    nations = fx.table(s, d, "nation").select(F.lit(0).cast("long").alias("net_id"), fx.node(fx.NATION, "n_nationkey").alias("node"))
    return basic.out_edges(e, nations).select("src", "dst", F.lit("out").alias("side")).union(basic.in_edges(e, nations).select("src", "dst", F.lit("in")))


@query(f"WITH {FD} SELECT net_id, dst AS src, src AS dst FROM fd")
def reverse_edges(s, d):
    return basic.reverse(fx.lattices(s, d)).select("net_id", "src", "dst")


@query(f"WITH {FA} SELECT dst AS node, min(src) AS parent FROM fa GROUP BY dst UNION ALL SELECT 0, 0")
def parents(s, d):
    return basic.parents(fx.commerce(s, d)).select("node", "parent")


@query(f"WITH {FD} SELECT DISTINCT net_id, dst AS node, r_name AS label FROM fd JOIN region ON dst = 1000000000000 + r_regionkey")
def labeled_leaves(s, d):
    return basic.leaf_labels(fx.lattices(s, d), fx.lattice_labels(s, d)).select("net_id", "node", "label")


_GEO_LABELS = "lab AS (SELECT 1000000000000 + r_regionkey AS node, r_name AS label FROM region UNION ALL SELECT 2000000000000 + n_nationkey, n_name FROM nation UNION ALL SELECT 3000000000000 + c_custkey, c_name FROM customer)"


@query(f"WITH {FB}, {_GEO_LABELS} SELECT src, dst, coalesce(a.label, '') AS src_label, coalesce(b.label, '') AS dst_label, (dst % 1000) / 4.0::DOUBLE AS length FROM fb LEFT JOIN lab a ON a.node = src LEFT JOIN lab b ON b.node = dst")
def labeled_branches(s, d):
    return basic.labelled_branches(fx.geo_tree(s, d).withColumn("length", F.col("dst") % 1000 / 4), fx.geo_labels(s, d)).select("src", "dst", "src_label", "dst_label", "length")


@query(f"""WITH {FD}, ends AS (SELECT net_id, src AS node, dst AS c, NULL::BIGINT AS p FROM fd UNION ALL SELECT net_id, dst, NULL, src FROM fd)
    SELECT net_id, node, coalesce(string_agg(p::VARCHAR, ',' ORDER BY p), '') AS parents, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c), '') AS children, coalesce(max(r_name), '') AS label
    FROM ends LEFT JOIN region ON node = 1000000000000 + r_regionkey GROUP BY net_id, node""")
def tree_summary(s, d):
    return basic.tree_summary(fx.lattices(s, d), fx.lattice_labels(s, d)).select("net_id", "node", "parents", "children", "label")


@query("SELECT conv_id AS net_id, turn + 11000000000000 AS node, length(text) - length(replace(text, 'n', '')) AS num_n FROM conversations")
def node_data(s, d):
    c = fx.table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("net_id"), fx.node(fx.TURN, "turn").alias("node"), scalar.count_letter(F.col("text"), "n").alias("num_n"))


@query(f"WITH {FD} SELECT net_id, count(*) = (SELECT count(*) FROM (SELECT src FROM fd x WHERE x.net_id = fd.net_id UNION SELECT dst FROM fd x WHERE x.net_id = fd.net_id)) - 1 AS is_tree FROM fd GROUP BY net_id")
def is_tree_per_net(s, d):
    return basic.is_tree(fx.lattices(s, d))


@query("SELECT p_type AS type, count(DISTINCT p_name) < count(*) AS multi_labelled FROM part GROUP BY p_type")
def is_multi_labeled(s, d):
    return basic.is_multi_labelled(fx.part_tree_labels(s, d), "type")


@query(f"""WITH {FD}, {DEGN.format(t='fd')} SELECT net_id, 'reticulation in a tree' AS rule, count(*) AS n FROM deg WHERE indeg > 1 GROUP BY net_id""")
def validate_net(s, d):
    return validate(Network.from_edges(fx.lattices(s, d), fx.lattice_labels(s, d)), tree=True).groupBy("net_id", "rule").agg(F.count("*").alias("n"))


# ---- joins ---------------------------------------------------------------------------------

@query(f"WITH {FD} SELECT x.net_id, x.dst AS a, y.dst AS b, count(*) AS n_common, min(x.src) AS common_parent FROM fd x JOIN fd y ON x.net_id = y.net_id AND x.src = y.src AND x.dst < y.dst GROUP BY ALL")
def siblings(s, d):
    return basic.siblings(fx.lattices(s, d))


_MATCH = """WITH a AS (SELECT p_name AS label, count(*) AS n, min(8000000000000 + p_partkey) AS node FROM part WHERE p_brand < 'Brand#3' GROUP BY p_name),
    b AS (SELECT p_name AS label, count(*) AS n, min(8000000000000 + p_partkey) AS node FROM part WHERE p_brand >= 'Brand#3' GROUP BY p_name)"""


def _halves(s, d):
    p = fx.table(s, d, "part").select(fx.node(fx.PART, "p_partkey").alias("node"), F.col("p_name").alias("label"), "p_brand")
    return p.where("p_brand < 'Brand#3'"), p.where("p_brand >= 'Brand#3'")


@query(_MATCH + " SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.node AS node_a, b.node AS node_b FROM a FULL JOIN b ON a.label = b.label")
def label_matching(s, d):
    return basic.label_matching(*_halves(s, d))


@query(f"""WITH {FD}, odd AS (SELECT r_name AS label, count(DISTINCT (net_id, dst)) AS n, min(dst) AS node FROM fd JOIN region ON dst = 1000000000000 + r_regionkey WHERE net_id % 2 = 1 GROUP BY 1),
    even AS (SELECT r_name AS label, count(DISTINCT (net_id, dst)) AS n, min(dst) AS node FROM fd JOIN region ON dst = 1000000000000 + r_regionkey WHERE net_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(odd.label, even.label) AS label, coalesce(odd.n, 0) AS n_a, coalesce(even.n, 0) AS n_b, odd.node AS node_a, even.node AS node_b FROM odd FULL JOIN even ON odd.label = even.label""")
def leaf_label_matching(s, d):
    own = cut(basic.leaf_labels(fx.lattices(s, d), fx.lattice_labels(s, d)))
    return basic.label_matching(own.where("net_id % 2 = 1"), own.where("net_id % 2 = 0"))


@query("""WITH m AS (SELECT min(p_name) AS lo, max(p_name) AS hi FROM part), a AS (SELECT p_name AS label FROM part, m WHERE p_brand < 'Brand#3' AND p_name > lo), b AS (SELECT p_name AS label FROM part, m WHERE p_brand >= 'Brand#3' AND p_name < hi)
    SELECT label, 'guest only' AS side FROM (SELECT label FROM b EXCEPT SELECT label FROM a) UNION ALL SELECT label, 'host only' FROM (SELECT label FROM a EXCEPT SELECT label FROM b)""")
def label_cleanup(s, d):
    """The host lacks the first of all labels, the guest the last."""
    a, b = _halves(s, d)
    ends = F.broadcast(fx.table(s, d, "part").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi")))  # one row
    return basic.label_clean_up(a.join(ends, F.col("label") > F.col("lo")), b.join(ends, F.col("label") < F.col("hi")))


def _with_shortcuts(s, d):
    """Lattices with an arc from the root to every nation: triangles root, supplier, nation."""
    e = fx.lattices(s, d)
    extra = e.where("dst between 2000000000000 and 2999999999999").select("net_id", F.lit(0).cast("long").alias("src"), "dst", "length")
    return e.union(extra).distinct()


_FS = FD + ", fs AS (SELECT * FROM fd UNION SELECT net_id, 0, dst FROM fd WHERE dst BETWEEN 2000000000000 AND 2999999999999)"


@query(f"""WITH {_FS}, {DEGN.format(t='fs')} SELECT xy.net_id, xy.src AS x, xy.dst AS y, yz.dst AS z FROM fs xy JOIN fs yz ON yz.net_id = xy.net_id AND yz.src = xy.dst
    JOIN fs xz ON xz.net_id = xy.net_id AND xz.src = xy.src AND xz.dst = yz.dst JOIN deg a ON a.net_id = xy.net_id AND a.node = xy.src JOIN deg b ON b.net_id = xy.net_id AND b.node = xy.dst
    JOIN deg c ON c.net_id = xy.net_id AND c.node = yz.dst WHERE c.outdeg = 1 AND b.outdeg <= 2 AND a.outdeg = 2""")
def triangles(s, d):
    return basic.triangles(_with_shortcuts(s, d))


@query(f"WITH {FD}, {DEGN.format(t='fd')} SELECT fd.net_id, src, dst FROM fd JOIN deg a ON a.net_id = fd.net_id AND a.node = src AND a.outdeg = 1 JOIN deg b ON b.net_id = fd.net_id AND b.node = dst AND b.outdeg = 1")
def reti_chains(s, d):
    return basic.unary_chains(fx.lattices(s, d))


@query(f"WITH {FE}, {DEGN.format(t='fe')} SELECT fe.net_id, src AS node, count(*) AS n_leaves FROM fe JOIN deg ON deg.net_id = fe.net_id AND deg.node = dst GROUP BY 1, 2 HAVING max(outdeg) = 0 AND count(*) >= 2")
def cherries(s, d):
    return basic.cherries(fx.event_trees(s, d)[0])


# ---- sets ----------------------------------------------------------------------------------

@query(f"""WITH {FH}, p AS (SELECT DISTINCT set_id AS a, set_id + 1 AS b FROM fh WHERE set_id + 1 IN (SELECT set_id FROM fh)), n AS (SELECT set_id, count(*) AS n FROM fh GROUP BY set_id),
    k AS (SELECT a, b, count(y.item) AS k FROM p JOIN fh x ON x.set_id = a LEFT JOIN fh y ON y.set_id = b AND y.item = x.item GROUP BY a, b)
    SELECT a, b, k AS n_intersect, na.n + nb.n - k AS n_union, na.n - k AS n_except, na.n + nb.n - 2 * k AS n_symdiff, k = 0 AS disjoint, (k = na.n AND k = nb.n) AS same
    FROM k JOIN n na ON na.set_id = a JOIN n nb ON nb.set_id = b""")
def set_pairs(s, d):
    h = fx.supplier_parts(s, d)
    ids = h.select("set_id").distinct()
    pairs = ids.select(F.col("set_id").alias("a"), (F.col("set_id") + 1).alias("b")).join(ids.select(F.col("set_id").alias("b")), "b", "left_semi").select("a", "b")
    return sets.pairwise(h, pairs)


def _next_sets(h: DataFrame) -> DataFrame:
    ids = h.select("set_id").distinct()
    return ids.select(F.col("set_id").alias("a"), (F.col("set_id") + 1).alias("b")).join(ids.select(F.col("set_id").alias("b")), "b", "left_semi").select("a", "b")


_TWO = FH + ", p AS (SELECT DISTINCT set_id AS a, set_id + 1 AS b FROM fh WHERE set_id + 1 IN (SELECT set_id FROM fh)), x AS (SELECT a, b, item FROM p JOIN fh ON set_id = a), y AS (SELECT a, b, item FROM p JOIN fh ON set_id = b)"
for _name, _cond, _sql in (("set_intersect", "in_a and in_b", "SELECT * FROM x INTERSECT SELECT * FROM y"), ("set_union", "in_a or in_b", "SELECT * FROM x UNION SELECT * FROM y"),
                           ("set_except", "in_a and not in_b", "SELECT * FROM x EXCEPT SELECT * FROM y"),
                           ("set_symdiff", "in_a <> in_b", "(SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT SELECT * FROM x)")):
    def _members(s, d, cond=_cond):
        h = cut(fx.supplier_parts(s, d))
        return sets.of_pairs(h, _next_sets(h)).where(cond).select("a", "b", "item")

    QUERIES[_name], ORACLES[_name] = _members, f"WITH {_TWO} {_sql}"


@query(f"WITH {FH} SELECT s_suppkey AS set_id, (SELECT count(*) FROM part) - count(item) AS n_missing FROM supplier LEFT JOIN fh ON set_id = s_suppkey GROUP BY s_suppkey")
def set_complement(s, d):
    parts = fx.table(s, d, "part").select(F.col("p_partkey").alias("item"))
    return sets.complement(fx.supplier_parts(s, d), parts, fx.table(s, d, "supplier").select(F.col("s_suppkey").alias("set_id")))


@query(f"WITH {FH} SELECT set_id, count(*) AS n, min(item) AS lo, max(item) AS hi, sum(CASE WHEN item > 100 THEN 1 ELSE 0 END) AS n_larger FROM fh GROUP BY set_id")
def set_facts(s, d):
    return fx.supplier_parts(s, d).groupBy("set_id").agg(F.count("*").alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi"), F.sum((F.col("item") > 100).cast("int")).alias("n_larger"))


@query(f"WITH {FH} SELECT set_id, list_sort(list(item))[3] AS third FROM fh GROUP BY set_id")
def kth_member(s, d):
    return sets.kth_member(fx.supplier_parts(s, d), 2).withColumnRenamed("item", "third")


@query("""WITH o AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS items FROM lineitem GROUP BY l_orderkey) SELECT min(k) AS first_set, count(*) AS n_sets FROM o GROUP BY items""")
def set_hash(s, d):
    """Orders with the same suppliers, by the hash of the set."""
    own = fx.table(s, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(sets.set_hash(F.col("l_suppkey")).alias("h"))
    return own.groupBy("h").agg(F.min("l_orderkey").alias("first_set"), F.count("*").alias("n_sets")).drop("h")


@query("""SELECT c_custkey AS key, 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT p_partkey, 'part', p_name FROM part""")
def merge_sorted(s, d):
    part = lambda name, c: fx.table(s, d, name).select(F.col(f"{c}key").alias("key"), F.lit(name).alias("kind"), F.col(f"{c[0]}_name").alias("name"))
    return sets.merge_sorted([part("customer", "c_cust"), part("supplier", "s_supp"), part("part", "p_part")], ["key", "kind"])


# ---- traversal -------------------------------------------------------------------------------

@query(f"WITH RECURSIVE {FB}, {CLOSURE} SELECT node, max(dist) AS depth FROM up GROUP BY node")
def depth(s, d):
    return recursion.tree_facts(fx.geo_tree(s, d)).select("node", F.col("depth").cast("int").alias("depth"))


@query(f"WITH RECURSIVE {FB}, {CLOSURE} SELECT node, anc, dist FROM up")
def ancestors(s, d):
    return recursion.tree_closure(fx.geo_tree(s, d)).select("node", "anc", "dist")


@query(f"WITH RECURSIVE {FB}, {CLOSURE} SELECT anc AS node, count(*) AS size FROM up GROUP BY anc")
def subtree_size(s, d):
    return recursion.tree_facts(fx.geo_tree(s, d)).select("node", "size")


@query(f"WITH RECURSIVE {FB}, {CLOSURE}, {WALK}, {ORDERED} SELECT node, pre FROM ord")
def preorder(s, d):
    return order.orders(fx.geo_tree(s, d)).select("node", "pre")


@query(f"WITH RECURSIVE {FB}, {CLOSURE}, {WALK}, {ORDERED} SELECT node, pre + size - 1 - depth AS post FROM ord JOIN siz USING (node)")
def postorder(s, d):
    return order.orders(fx.geo_tree(s, d)).select("node", "post")


@query(f"""WITH RECURSIVE {FB}, {CLOSURE}, {WALK}, {ORDERED}, o AS (SELECT node, 2 * pre - depth AS visit, size FROM ord JOIN siz USING (node)), k AS (SELECT fb.src, visit + 2 * size - 1 AS visit, lead(fb.dst) OVER (PARTITION BY fb.src ORDER BY fb.dst) AS later FROM fb JOIN o ON o.node = fb.dst)
    SELECT 3 * visit AS at, node, 'pre' AS kind FROM o UNION ALL SELECT 3 * visit + 1, src, 'in' FROM k WHERE later IS NOT NULL UNION ALL SELECT 3 * (visit + 2 * size - 2) + 2, node, 'post' FROM o""")
def dfs_visits(s, d):
    return order.visits(cut(order.orders(fx.geo_tree(s, d)))).select("at", "node", "kind")


# A depth-first search of an acyclic network reaches every node by its least path.
@query(f"""WITH RECURSIVE {FD}, p AS (SELECT DISTINCT net_id, 0::BIGINT AS node, [0::BIGINT] AS path FROM fd UNION ALL SELECT p.net_id, fd.dst, list_append(p.path, fd.dst) FROM p JOIN fd ON fd.net_id = p.net_id AND fd.src = p.node),
    m AS (SELECT net_id, node, min(path) AS path FROM p GROUP BY net_id, node) SELECT net_id, path[-2] AS src, node AS dst, row_number() OVER (PARTITION BY net_id ORDER BY path) - 1 AS nr FROM m WHERE len(path) > 1""")
def dfs_arcs(s, d):
    return order.dfs_arcs(fx.lattices(s, d))


@query("""WITH e AS (SELECT 2 * o_orderkey AS p, 3000000000000 + o_custkey AS node FROM orders UNION ALL SELECT 2 * o_orderkey + 1, 5000000000000 + o_orderkey FROM orders), f AS (SELECT node, min(p) AS p FROM e GROUP BY node)
    SELECT node, row_number() OVER (ORDER BY p) - 1 AS id FROM f""")
def first_appearance(s, d):
    e = fx.table(s, d, "orders").select(F.lit(0).cast("long").alias("net_id"), fx.node(fx.CUSTOMER, "o_custkey").alias("src"), fx.node(fx.ORDER, "o_orderkey").alias("dst"), F.col("o_orderkey").alias("pos"))
    return order.first_appearance(e).select("node", "id")


@query(f"WITH RECURSIVE {FB}, {WALK}, o AS (SELECT node, lag(node) OVER (ORDER BY path) AS before FROM walk) SELECT coalesce(bool_and(before < node), true) AS preordered FROM o")
def is_preordered(s, d):
    return order.is_preordered(order.orders(fx.geo_tree(s, d))).select("preordered")


@query(f"WITH RECURSIVE {FA}, r AS (SELECT 2000000000000 + min(n_nationkey) AS node FROM nation UNION SELECT dst FROM r JOIN fa ON src = node) SELECT node FROM r")
def reachable(s, d):
    return recursion.reach(fx.commerce(s, d), _first_nation(s, d)).select("node")


def _first_nation(s, d):
    return fx.table(s, d, "nation").agg(F.min("n_nationkey").alias("k")).select(F.lit(0).cast("long").alias("net_id"), fx.node(fx.NATION, "k").alias("node"))


def _reticulations(s, d):
    return basic.degree(fx.commerce(s, d)).where(basic.is_reticulation()).select("net_id", "node")


@query(f"WITH RECURSIVE {FA}, {DEG.format(t='fa')}, f AS (SELECT node FROM deg WHERE indeg >= 2), r AS (SELECT 0::BIGINT AS node UNION SELECT dst FROM r JOIN fa ON src = node WHERE dst NOT IN (SELECT node FROM f)) SELECT node FROM r")
def reachable_except(s, d):
    root = s.range(1).select(F.col("id").alias("net_id"), F.col("id").alias("node"))
    return recursion.reach(fx.commerce(s, d), root, _reticulations(s, d)).select("node")


@query(f"WITH RECURSIVE {FA}, r AS (SELECT 2000000000000 + min(n_nationkey) AS node FROM nation UNION SELECT dst FROM r JOIN fa ON src = node) SELECT src, dst FROM fa WHERE src IN (SELECT node FROM r)")
def edges_below(s, d):
    return recursion.edges_below(fx.commerce(s, d), _first_nation(s, d)).select("src", "dst")


def _neighbours(o: DataFrame) -> DataFrame:
    """Pairs of orders with consecutive keys, by an equi-join."""
    return o.join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderkey").alias("b")), "o_orderkey").select(
        F.lit(0).cast("long").alias("net_id"), fx.node(fx.ORDER, "o_orderkey").alias("a"), fx.node(fx.ORDER, "b").alias("b"))


def _order_pairs(s, d):
    return _neighbours(fx.table(s, d, "orders").select("o_orderkey"))


_PAIRS = "pairs AS (SELECT 5000000000000 + x.o_orderkey AS a, 5000000000000 + y.o_orderkey AS b FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1)"
_LCA = f"WITH RECURSIVE {FB}, {CLOSURE}, {_PAIRS} SELECT a, b, arg_min(x.anc, x.dist) AS lca FROM pairs JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc GROUP BY a, b"


@query(_LCA)
def lca_pairs(s, d):
    return lca.lca(cut(recursion.tree_closure(fx.geo_tree(s, d))), _order_pairs(s, d)).select("a", "b", "lca")


@query(_LCA)
def lca_rmq(s, d):
    return lca.lca_by_tour(cut(order.orders(fx.geo_tree(s, d))), _order_pairs(s, d)).select("a", "b", "lca")


_MIXED = "q AS (SELECT 2000000000000 + n_nationkey AS a, 5000000000000 + o_orderkey AS b FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)"


def _mixed_pairs(s, d):
    o = fx.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("n_nationkey"))
    return o.join(fx.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")), "n_nationkey").select(F.lit(0).cast("long").alias("net_id"), fx.node(fx.NATION, "n_nationkey").alias("a"), fx.node(fx.ORDER, "o_orderkey").alias("b"))


@query(f"WITH RECURSIVE {FB}, {CLOSURE}, {_MIXED} SELECT a, b, EXISTS (SELECT 1 FROM up WHERE up.node = b AND up.anc = a) AS has_path FROM q")
def has_path(s, d):
    return lca.has_path(cut(order.orders(fx.geo_tree(s, d))), _mixed_pairs(s, d)).select("a", "b", "has_path")


@query(f"WITH RECURSIVE {FB}, {CLOSURE}, {_MIXED} SELECT b AS a, a AS b, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.node = q.b AND up.anc = q.a) THEN q.b END AS minimum FROM q")
def get_minimum(s, d):
    p = _mixed_pairs(s, d).select("net_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return lca.get_minimum(cut(order.orders(fx.geo_tree(s, d))), p).select("a", "b", "minimum")


@query(f"""WITH RECURSIVE {FD}, {DEGN.format(t='fd')}, w AS (SELECT net_id, dst AS node, src AS anc FROM fd UNION SELECT w.net_id, w.node, fd.src FROM w JOIN deg ON deg.net_id = w.net_id AND deg.node = w.anc AND deg.outdeg = 1 JOIN fd ON fd.net_id = w.net_id AND fd.dst = w.anc)
    SELECT w.net_id, w.node, w.anc FROM w JOIN deg ON deg.net_id = w.net_id AND deg.node = w.anc AND deg.outdeg <> 1""")
def lowest_tree_ancestors(s, d):
    e = cut(fx.lattices(s, d))
    return recursion.lowest_tree_ancestors(e, basic.degree(e))


@query(f"""WITH RECURSIVE {FD}, p AS (SELECT DISTINCT net_id, 0::BIGINT AS node FROM fd UNION ALL SELECT p.net_id, fd.dst FROM p JOIN fd ON fd.net_id = p.net_id AND fd.src = p.node)
    SELECT net_id, node, count(*) AS n_paths FROM p GROUP BY net_id, node""")
def path_counts(s, d):
    return recursion.path_counts(fx.lattices(s, d))


@query(f"""WITH RECURSIVE {FD}, p AS (SELECT DISTINCT net_id, 0::BIGINT AS node, '0' AS path FROM fd UNION ALL SELECT p.net_id, fd.dst, p.path || '.' || fd.dst::VARCHAR FROM p JOIN fd ON fd.net_id = p.net_id AND fd.src = p.node)
    SELECT net_id, path, node FROM p""")
def unzip_multree(s, d):
    return rewrite.unzip(fx.lattices(s, d))


@query(f"""WITH RECURSIVE {FB}, {CLOSURE}, {WALK}, {ORDERED}, first AS (SELECT 2 * pre - depth AS visit, node, depth FROM ord),
    again AS (SELECT 2 * pre - depth + 2 * size - 1 AS visit, fb.src AS node, depth - 1 AS depth FROM ord JOIN siz USING (node) JOIN fb ON fb.dst = node) SELECT * FROM first UNION ALL SELECT * FROM again""")
def euler_tour(s, d):
    return order.euler_tour(cut(order.orders(fx.geo_tree(s, d)))).select("visit", "node", "depth")


@query(f"SELECT * FROM (WITH {FG} SELECT seq_id, i, arg_min(i, val) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS arg FROM fg)")
def rmq_sliding(s, d):
    return fx.event_sequences(s, d).select("seq_id", "i", order.sliding_min(10).alias("arg"))


def _ranges(s, d):
    g = fx.event_sequences(s, d)
    n = g.groupBy("seq_id").agg(F.count("*").alias("n"))
    return g.join(n, "seq_id").select("seq_id", F.col("i").alias("lo"), F.least(F.col("n"), F.col("i") + 1 + (F.col("i") * 7) % 40).alias("hi"))


_RMQ = f"""WITH {FG}, n AS (SELECT seq_id, count(*) AS n FROM fg GROUP BY seq_id), q AS (SELECT seq_id, i AS lo, least(n, i + 1 + (i * 7) % 40) AS hi FROM fg JOIN n USING (seq_id))
    SELECT q.seq_id, lo, hi, min(val) AS val, arg_min(i, (val, i)) AS arg FROM q JOIN fg ON fg.seq_id = q.seq_id AND i >= lo AND i < hi GROUP BY q.seq_id, lo, hi"""


@query(_RMQ)
def rmq_sparse(s, d):
    return order.rmq(order.sparse_table(cut(fx.event_sequences(s, d))), _ranges(s, d))


@query(_RMQ)
def rmq_blocks(s, d):
    return order.block_rmq(cut(fx.event_sequences(s, d)), _ranges(s, d))


@query(_RMQ)
def rmq_naive(s, d):
    return order.all_intervals(fx.event_sequences(s, d), _ranges(s, d))


@query(_RMQ)
def rmq_cartesian(s, d):
    return order.cartesian_rmq(cut(fx.event_sequences(s, d)), _ranges(s, d))


@query(f"""WITH {FG} SELECT x.seq_id, x.i, max(y.i) FILTER (y.i < x.i) AS prev, min(y.i) FILTER (y.i > x.i) AS next FROM fg x LEFT JOIN fg y ON y.seq_id = x.seq_id AND y.val < x.val GROUP BY x.seq_id, x.i""")
def nearest_smaller(s, d):
    return order.nearest_smaller(fx.event_sequences(s, d))


@query(f"""WITH {FG}, n AS (SELECT x.seq_id, x.i, max(y.i) FILTER (y.i < x.i AND y.val <= x.val) AS l, min(y.i) FILTER (y.i > x.i AND y.val < x.val) AS r FROM fg x LEFT JOIN fg y ON y.seq_id = x.seq_id GROUP BY x.seq_id, x.i)
    SELECT n.seq_id, n.i, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN a.val > b.val THEN l ELSE r END AS parent FROM n LEFT JOIN fg a ON a.seq_id = n.seq_id AND a.i = l LEFT JOIN fg b ON b.seq_id = n.seq_id AND b.i = r""")
def cartesian_tree(s, d):
    return order.cartesian_tree(fx.event_sequences(s, d))


@query(f"WITH {FG}, b AS (SELECT *, lag(val) OVER (PARTITION BY seq_id ORDER BY i) AS p FROM fg) SELECT seq_id, coalesce(min(i) FILTER (val < p), max(i) + 1) AS n FROM b GROUP BY seq_id")
def sorted_prefix(s, d):
    return order.sorted_prefix(fx.event_sequences(s, d))


@query(f"""WITH RECURSIVE {FB}, {CLOSURE}, {WALK}, own AS (SELECT node, row_number() OVER (ORDER BY path) AS r FROM walk WHERE node >= 5000000000000),
    p AS (SELECT x.node AS a, y.node AS b FROM own x JOIN own y ON y.r = x.r + 1), l AS (SELECT a, b, arg_min(x.anc, x.dist) AS node FROM p JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc GROUP BY a, b),
    kept AS (SELECT node FROM l UNION SELECT node FROM own) SELECT arg_min(anc, dist) AS src, node AS dst FROM up WHERE dist > 0 AND node IN (SELECT node FROM kept) AND anc IN (SELECT node FROM kept) GROUP BY node""")
def induced_subtree(s, d):
    e = fx.geo_tree(s, d)
    c = cut(recursion.tree_closure(e))
    chosen = fx.table(s, d, "orders").select(F.lit(0).cast("long").alias("net_id"), fx.node(fx.ORDER, "o_orderkey").alias("node"))
    return lca.induced_subtree(cut(order.orders(e)), c, chosen).select("src", "dst")


# ---- structure -------------------------------------------------------------------------------

_FC = FD + ", fc AS (SELECT * FROM fd UNION SELECT net_id, r, s FROM fd0 WHERE net_id % 10 = 0)"


@query(f"""WITH RECURSIVE {_FC}, r AS (SELECT net_id, src AS x, dst AS node FROM fc UNION SELECT r.net_id, r.x, fc.dst FROM r JOIN fc ON fc.net_id = r.net_id AND fc.src = r.node)
    SELECT net_id, bool_or(x = node) AS cyclic FROM r GROUP BY net_id""")
def cycle_check(s, d):
    e = fx.lattices(s, d)
    line = e.where("src = 0").select("net_id", F.col("dst").alias("s"))
    mid = e.where("src > 0").select("net_id", "src", "dst")
    back = line.join(mid.select("net_id", F.col("src").alias("s"), F.col("dst").alias("n")), ["net_id", "s"]).join(mid.select("net_id", F.col("src").alias("n"), F.col("dst").alias("r")), ["net_id", "n"])
    planted = cut(e.union(back.where("net_id % 10 = 0").select("net_id", "r", "s", F.lit(None).cast("double"))))
    bad = structure.cyclic_nodes(planted).select("net_id").distinct().withColumn("cyclic", F.lit(True))
    return planted.select("net_id").distinct().join(bad, "net_id", "left").select("net_id", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


_BRIDGES = """und AS (SELECT net_id, src AS a, dst AS b FROM fd UNION ALL SELECT net_id, dst, src FROM fd),
    r AS (SELECT net_id, src, dst, dst AS node FROM fd UNION SELECT r.net_id, r.src, r.dst, u.b FROM r JOIN und u ON u.net_id = r.net_id AND u.a = r.node WHERE NOT (u.a = r.src AND u.b = r.dst) AND NOT (u.a = r.dst AND u.b = r.src)),
    br AS (SELECT net_id, src, dst FROM r GROUP BY net_id, src, dst HAVING NOT bool_or(node = src))"""


@query(f"WITH RECURSIVE {FD}, {_BRIDGES} SELECT net_id, src, dst FROM br")
def bridges(s, d):
    return structure.bridges(fx.lattices(s, d))


@query(f"""WITH RECURSIVE {FD}, {_BRIDGES}, rest AS (SELECT net_id, src, dst FROM fd EXCEPT SELECT net_id, src, dst FROM br), u2 AS (SELECT net_id, src AS a, dst AS b FROM rest UNION ALL SELECT net_id, dst, src FROM rest),
    c AS (SELECT net_id, src AS node, src AS other FROM fd UNION SELECT net_id, dst, dst FROM fd UNION SELECT c.net_id, c.node, u2.b FROM c JOIN u2 ON u2.net_id = c.net_id AND u2.a = c.other)
    SELECT net_id, node, min(other) AS block FROM c GROUP BY net_id, node""")
def blocks(s, d):
    return structure.blocks(cut(fx.lattices(s, d)))


@query(f"""WITH RECURSIVE {FD}, e AS (SELECT net_id, src, dst FROM fd WHERE src > 0), u AS (SELECT net_id, src AS a, dst AS b FROM e UNION ALL SELECT net_id, dst, src FROM e),
    c AS (SELECT net_id, a AS node, a AS other FROM u UNION SELECT c.net_id, c.node, u.b FROM c JOIN u ON u.net_id = c.net_id AND u.a = c.other)
    SELECT net_id, node, min(other) AS comp FROM c GROUP BY net_id, node""")
def connected_components(s, d):
    e = cut(fx.lattices(s, d).where("src > 0"))
    return recursion.connected(e, basic.nodes(e))


@query(f"""WITH RECURSIVE {FD}, e AS (SELECT net_id, src, dst FROM fd WHERE src > 0), u AS (SELECT net_id, src AS a, dst AS b FROM e UNION ALL SELECT net_id, dst, src FROM e),
    c AS (SELECT net_id, a AS node, a AS other FROM u UNION SELECT c.net_id, c.node, u.b FROM c JOIN u ON u.net_id = c.net_id AND u.a = c.other), m AS (SELECT net_id, node, min(other) AS comp FROM c GROUP BY net_id, node)
    SELECT net_id, comp, count(*) AS n_nodes FROM m GROUP BY net_id, comp""")
def component_sizes(s, d):
    e = cut(fx.lattices(s, d).where("src > 0"))
    return recursion.component_sizes(e, basic.nodes(e))


@query(f"""WITH RECURSIVE {FD}, {DEGN.format(t='fd')}, inn AS (SELECT net_id, node FROM deg WHERE outdeg > 0 AND indeg <= 1), arc AS (SELECT fd.net_id, src, dst FROM fd JOIN inn a ON a.net_id = fd.net_id AND a.node = src JOIN inn b ON b.net_id = fd.net_id AND b.node = dst),
    t AS (SELECT net_id, node, node AS comp FROM inn WHERE NOT EXISTS (SELECT 1 FROM arc WHERE arc.net_id = inn.net_id AND arc.dst = inn.node) UNION ALL SELECT t.net_id, arc.dst, t.comp FROM t JOIN arc ON arc.net_id = t.net_id AND arc.src = t.node)
    SELECT net_id, node, comp FROM t""")
def tree_components(s, d):
    return structure.tree_components(cut(fx.lattices(s, d)))


_COMP = f"""WITH RECURSIVE {FD}, {DEGN.format(t='fd')}, inn AS (SELECT net_id, node FROM deg WHERE outdeg > 0 AND indeg <= 1), arc AS (SELECT fd.net_id, src, dst FROM fd JOIN inn a ON a.net_id = fd.net_id AND a.node = src JOIN inn b ON b.net_id = fd.net_id AND b.node = dst),
    t AS (SELECT net_id, node, node AS comp FROM inn WHERE NOT EXISTS (SELECT 1 FROM arc WHERE arc.net_id = inn.net_id AND arc.dst = inn.node) UNION ALL SELECT t.net_id, arc.dst, t.comp FROM t JOIN arc ON arc.net_id = t.net_id AND arc.src = t.node),
    st AS (SELECT net_id, comp AS node, true AS is_root FROM t WHERE node = comp UNION ALL SELECT net_id, node, false FROM deg WHERE outdeg = 0 AND indeg <= 1),
    w AS (SELECT st.net_id, st.node, st.is_root, fd.src AS at FROM st JOIN fd ON fd.net_id = st.net_id AND fd.dst = st.node UNION SELECT w.net_id, w.node, w.is_root, fd.src FROM w JOIN fd ON fd.net_id = w.net_id AND fd.dst = w.at WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.net_id = w.net_id AND t.node = w.at)),
    met AS (SELECT DISTINCT w.net_id, w.node, w.is_root, t.comp FROM w JOIN t ON t.net_id = w.net_id AND t.node = w.at)"""


def _with_leaves(s, d):
    """Lattices with two leaves below every region: regions of one nation start components below reticulations."""
    e = fx.lattices(s, d)
    regions = e.where("dst < 2000000000000").select("net_id", "dst").distinct()
    more = regions.select("net_id", F.col("dst").alias("src"), F.explode(F.array(F.col("dst") + 20 * fx.UNIT, F.col("dst") + 30 * fx.UNIT)).alias("dst"), F.lit(None).cast("double").alias("length"))
    return e.union(more)


_FK = FD.replace("fd AS (SELECT net_id, 0", "fdx AS (SELECT net_id, 0") + ", fd AS (SELECT * FROM fdx UNION ALL SELECT DISTINCT net_id, r, r + 20000000000000 FROM fd0 UNION ALL SELECT DISTINCT net_id, r, r + 30000000000000 FROM fd0)"


@query(_COMP.replace(FD, _FK) + " SELECT net_id, comp AS src, node AS dst FROM met WHERE is_root")
def component_dag(s, d):
    return structure.component_facts(cut(_with_leaves(s, d)))[0]


@query(_COMP + ", one AS (SELECT net_id, node, min(comp) AS comp FROM met WHERE NOT is_root GROUP BY net_id, node HAVING min(comp) = max(comp)) SELECT net_id, comp, min(node) AS leaf FROM one GROUP BY net_id, comp")
def visible_leaf(s, d):
    return structure.component_facts(cut(fx.lattices(s, d)))[1]


_PATHS = _COMP.replace(FD, _FK) + """, top AS (SELECT net_id, node FROM t WHERE node = comp), q AS (SELECT net_id, node AS src, node FROM top UNION ALL SELECT q.net_id, q.src, fd.dst FROM q JOIN fd ON fd.net_id = q.net_id AND fd.src = q.node),
    np AS (SELECT q.net_id, q.src, q.node AS dst, count(*) AS n_paths FROM q JOIN top ON top.net_id = q.net_id AND top.node = q.node WHERE q.src <> q.node GROUP BY ALL)"""


@query(_PATHS + " SELECT * FROM np")
def component_paths(s, d):
    return structure.component_paths(cut(_with_leaves(s, d)))


@query(_PATHS + """, sees AS (SELECT net_id, min(comp) AS comp FROM met WHERE NOT is_root GROUP BY net_id, node HAVING min(comp) = max(comp)), h AS (SELECT net_id, node AS comp, coalesce((SELECT max(n_paths) FROM np WHERE np.net_id = top.net_id AND np.src = top.node), 1) = 1 AS half FROM top)
    SELECT net_id, comp, half AS half_eligible, half AND EXISTS (SELECT 1 FROM sees WHERE sees.net_id = h.net_id AND sees.comp = h.comp) AS eligible FROM h""")
def eligible_components(s, d):
    return structure.eligible_components(cut(_with_leaves(s, d)))


# All components end in the root's here, so every way up from a reticulation sees one.
@query(_COMP.replace(FD, _FK) + """, v AS (SELECT fd.net_id, fd.dst AS node, fd.src AS at FROM fd UNION SELECT v.net_id, v.node, fd.src FROM v JOIN fd ON fd.net_id = v.net_id AND fd.dst = v.at WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.net_id = v.net_id AND t.node = v.at)),
    ag AS (SELECT v.net_id, v.node, min(t.comp) AS comp FROM v JOIN t ON t.net_id = v.net_id AND t.node = v.at GROUP BY v.net_id, v.node HAVING min(t.comp) = max(t.comp)),
    se AS (SELECT net_id, node, comp FROM t UNION ALL SELECT net_id, node, comp FROM ag WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.net_id = ag.net_id AND t.node = ag.node)),
    si AS (SELECT se.net_id, se.node, EXISTS (SELECT 1 FROM met WHERE met.is_root AND met.net_id = se.net_id AND met.comp = se.comp) AS inn FROM se),
    c AS (SELECT fd.net_id, fd.dst AS node, count(*) FILTER (inn IS NULL) AS n_none, count(*) FILTER (inn) AS n_inner, count(*) FILTER (NOT inn) AS n_leaf FROM fd JOIN deg ON deg.net_id = fd.net_id AND deg.node = fd.dst AND deg.indeg > 1 LEFT JOIN si ON si.net_id = fd.net_id AND si.node = fd.src GROUP BY fd.net_id, fd.dst)
    SELECT *, false AS candidate, false AS best FROM c""")
def branch_counts(s, d):
    return structure.branch_counts(_with_leaves(s, d))


# Reachability from the root that avoids x; what is lost is dominated by x.
_DOM = f"""WITH RECURSIVE {FD}, nod AS (SELECT net_id, src AS node FROM fd UNION SELECT net_id, dst FROM fd), av AS (SELECT net_id, node AS x, 0::BIGINT AS node FROM nod WHERE node <> 0
    UNION SELECT av.net_id, av.x, fd.dst FROM av JOIN fd ON fd.net_id = av.net_id AND fd.src = av.node AND fd.dst <> av.x),
    dom AS (SELECT a.net_id, b.node, a.node AS dom FROM nod a JOIN nod b ON b.net_id = a.net_id WHERE a.node = 0 OR NOT EXISTS (SELECT 1 FROM av WHERE av.net_id = a.net_id AND av.x = a.node AND av.node = b.node))"""


@query(_DOM + ", n AS (SELECT net_id, node, count(*) AS n FROM dom GROUP BY net_id, node) SELECT dom.net_id, dom.node, arg_max(dom.dom, n.n) AS idom FROM dom JOIN n ON n.net_id = dom.net_id AND n.node = dom.dom WHERE dom.node <> dom.dom GROUP BY dom.net_id, dom.node")
def dominators(s, d):
    return structure.immediate_dominators(structure.dominators(cut(fx.lattices(s, d))))


@query(_DOM + ", lf AS (SELECT net_id, dst AS node FROM fd EXCEPT SELECT net_id, src FROM fd) SELECT dom.net_id, dom.dom AS node, min(dom.node) AS leaf FROM dom JOIN lf ON lf.net_id = dom.net_id AND lf.node = dom.node GROUP BY 1, 2")
def leaf_stability(s, d):
    e = cut(fx.lattices(s, d))
    return structure.leaf_stability(e, structure.dominators(e))


# ---- rewrites --------------------------------------------------------------------------------

@query("""WITH c AS (SELECT conv_id AS net_id, max(turn) AS top, sum(length(text)) AS length FROM conversations GROUP BY conv_id) SELECT net_id, 0::BIGINT AS src, 11000000000000 + top AS dst, length::DOUBLE AS length FROM c""")
def suppress_chains(s, d):
    return rewrite.suppress_unary(fx.turn_chains(s, d))


@query(f"WITH {FD} SELECT DISTINCT net_id, CASE WHEN src BETWEEN 2000000000000 AND 2999999999999 THEN m ELSE src END AS src, CASE WHEN dst BETWEEN 2000000000000 AND 2999999999999 THEN m ELSE dst END AS dst FROM fd JOIN (SELECT net_id, min(n) AS m FROM fd0 GROUP BY net_id) USING (net_id)")
def contract_edges(s, d):
    e = cut(fx.lattices(s, d))
    nations = e.where("dst between 2000000000000 and 2999999999999").select("net_id", F.col("dst").alias("node")).distinct()
    into = nations.join(nations.groupBy("net_id").agg(F.min("node").alias("target")), "net_id")
    return rewrite.contract(e, into).select("net_id", "src", "dst")


@query(f"WITH {FD} SELECT net_id, src, dst FROM fd WHERE src > 0 UNION ALL SELECT net_id, 0, dst + 90000000000000 FROM fd WHERE src = 0 UNION ALL SELECT net_id, dst + 90000000000000, dst FROM fd WHERE src = 0")
def subdivide_edges(s, d):
    return rewrite.subdivide(fx.lattices(s, d), F.col("src") == 0, F.col("dst") + 90 * fx.UNIT).select("net_id", "src", "dst")


@query(f"WITH RECURSIVE {FA}, r AS (SELECT 2000000000000 + min(n_nationkey) AS node FROM nation UNION SELECT dst FROM r JOIN fa ON src = node) SELECT src, dst FROM fa WHERE src NOT IN (SELECT node FROM r) AND dst NOT IN (SELECT node FROM r)")
def remove_subtree(s, d):
    return rewrite.remove_subtrees(fx.commerce(s, d), _first_nation(s, d)).select("src", "dst")


@query(f"WITH {FD} SELECT DISTINCT net_id, CASE WHEN src BETWEEN 2000000000000 AND 2999999999999 THEN 0 ELSE src END AS src, dst FROM fd")
def replace_parent(s, d):
    e = fx.lattices(s, d)
    changes = e.where("src between 2000000000000 and 2999999999999").select("net_id", "dst", F.col("src").alias("old"), F.lit(0).cast("long").alias("new"))
    return rewrite.replace_parent(e, changes).select("net_id", "src", "dst")


@query(f"WITH {FD} SELECT DISTINCT net_id, src, CASE WHEN dst BETWEEN 4000000000000 AND 4999999999999 THEN dst + 1000000000 ELSE dst END AS dst FROM fd")
def replace_child(s, d):
    e = fx.lattices(s, d)
    return rewrite.replace_child(e, e.where("src = 0").select("net_id", "src", F.col("dst").alias("old"), (F.col("dst") + 10**9).alias("new"))).select("net_id", "src", "dst")


@query(f"""WITH {FB}, e AS (SELECT * FROM fb WHERE dst NOT IN (SELECT 5000000000000 + o_orderkey FROM orders WHERE o_orderstatus = 'F')), f AS (SELECT * FROM e WHERE dst NOT IN (SELECT src FROM fb EXCEPT SELECT src FROM e)),
    g AS (SELECT * FROM f WHERE dst NOT IN (SELECT src FROM fb EXCEPT SELECT src FROM f)), h AS (SELECT * FROM g WHERE dst NOT IN (SELECT src FROM fb EXCEPT SELECT src FROM g)) SELECT src, dst FROM h""")
def remove_upwards(s, d):
    gone = fx.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.lit(0).cast("long").alias("net_id"), fx.node(fx.ORDER, "o_orderkey").alias("node"))
    return rewrite.remove_upwards(fx.geo_tree(s, d), gone).select("src", "dst")


@query(f"WITH {FD} SELECT DISTINCT net_id, src, n AS dst FROM (SELECT net_id, 0::BIGINT AS src, n FROM fd0 UNION SELECT net_id, n, r FROM fd0)")
def remove_node(s, d):
    e = cut(fx.lattices(s, d))
    return rewrite.remove_node(e, e.where("src = 0").select("net_id", F.col("dst").alias("node"))).select("net_id", "src", "dst")


@query(f"""WITH {FB}, m AS (SELECT min(n_nationkey) AS k, arg_min(n_regionkey, n_nationkey) AS r FROM nation), path AS (SELECT 0::BIGINT AS src, 1000000000000 + r AS dst FROM m UNION ALL SELECT 1000000000000 + r, 2000000000000 + k FROM m)
    SELECT src, dst FROM fb EXCEPT SELECT src, dst FROM path UNION ALL SELECT dst, src FROM path""")
def set_root(s, d):
    return rewrite.set_root(fx.geo_tree(s, d), _first_nation(s, d)).select("src", "dst")


@query(f"WITH {FD} SELECT net_id, src, dst FROM fd WHERE src > 0 OR dst % 2 = 0 UNION SELECT net_id, 0, dst FROM fd WHERE src > 0 AND dst < 2000000000000")
def add_remove_edges(s, d):
    e = cut(fx.lattices(s, d))
    less = rewrite.remove_edges(e, e.where("src = 0 and dst % 2 = 1"))
    more = e.where("src > 0 and dst < 2000000000000").select("net_id", F.lit(0).cast("long").alias("src"), "dst", "length").distinct()
    return rewrite.add_edges(less, more).select("net_id", "src", "dst")


@query(f"WITH {FD} SELECT DISTINCT net_id, dst AS node, CASE WHEN dst = 1000000000000 THEN 'moved' ELSE r_name END AS label FROM fd JOIN region ON dst = 1000000000000 + r_regionkey WHERE dst <> 1000000000001")
def relabel(s, d):
    own = fx.lattice_labels(s, d)
    change = own.select("net_id", "node", F.when(F.col("node") == fx.UNIT, "moved").alias("label")).where(f"node in ({fx.UNIT}, {fx.UNIT + 1})")
    return rewrite.set_labels(own, change)


# ---- text ------------------------------------------------------------------------------------

_COUNTRY = """o AS (SELECT o_custkey AS c, string_agg('o' || o_orderkey::VARCHAR, ',' ORDER BY 'o' || o_orderkey::VARCHAR) AS t FROM orders GROUP BY o_custkey),
    c AS (SELECT c_nationkey AS n, coalesce('(' || o.t || ')', '') || c_name AS t FROM customer LEFT JOIN o ON o.c = c_custkey), n AS (SELECT n_nationkey AS net_id, coalesce('(' || string_agg(c.t, ',' ORDER BY c.t) || ')', '') || n_name || ';' AS newick FROM nation JOIN c ON c.n = n_nationkey GROUP BY n_nationkey, n_name)"""


def _nation_trees(s, d):
    c = fx.table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("net_id"), F.col("c_custkey"), "c_name")
    o = fx.table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("double")
    edges = c.select("net_id", (F.lit(2 * fx.UNIT) + F.col("net_id")).alias("src"), fx.node(fx.CUSTOMER, "c_custkey").alias("dst"), none.alias("length")).union(
        o.select("net_id", fx.node(fx.CUSTOMER, "c_custkey"), fx.node(fx.ORDER, "o_orderkey"), none))
    nations = fx.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("net_id"), fx.node(fx.NATION, "n_nationkey").alias("node"), F.col("n_name").alias("label"))
    labels = nations.union(c.select("net_id", fx.node(fx.CUSTOMER, "c_custkey"), "c_name")).union(o.select("net_id", fx.node(fx.ORDER, "o_orderkey"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))))
    return edges, labels


@query(f"WITH {_COUNTRY} SELECT net_id::BIGINT AS net_id, newick FROM n")
def newick_write(s, d):
    return newick.canonical_newick(*_nation_trees(s, d))


def _by_name(parsed: DataFrame) -> DataFrame:
    """Arcs between the names of nodes, which are their ids here."""
    names = newick.labels_of(parsed)
    at = lambda c: names.select("net_id", F.col("node").alias(c), F.col("label").cast("long").alias(f"_{c}"))
    return newick.edges_of(parsed).join(at("src"), ["net_id", "src"]).join(at("dst"), ["net_id", "dst"]).select("net_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "length")


@query(f"WITH {FD} SELECT net_id, src, dst, (dst % 1000) / 4.0::DOUBLE AS length FROM fd")
def newick_roundtrip(s, d):
    e = cut(fx.lattices(s, d).withColumn("length", F.col("dst") % 1000 / 4))
    labels = basic.nodes(e).select("net_id", "node", F.col("node").cast("string").alias("label"))
    text = newick.write_networks(e, labels)
    return _by_name(cut(newick.parse_table(text.select("net_id", F.col("newick").alias("value")))))


@query(f"WITH {FD} SELECT net_id, src, dst, (dst % 1000) / 4.0::DOUBLE AS length FROM fd")
def edgelist_parse(s, d):
    line = F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), (F.col("dst") % 1000 / 4).cast("string"))
    lines = fx.lattices(s, d).groupBy("net_id").agg(F.array_join(F.collect_list(line), "\n").alias("value"))
    return _by_name(cut(newick.parse_table(lines, newick.parse_edgelist)))


# ---- isomorphism -----------------------------------------------------------------------------

_AHU = """d AS (SELECT user_id, ts::DATE AS day, '(' || string_agg(event_type, ',' ORDER BY event_type) || ')' AS t FROM events GROUP BY 1, 2), u AS (SELECT user_id AS net_id, '(' || string_agg(t, ',' ORDER BY t) || ')' || ';' AS newick FROM d GROUP BY user_id)"""


@query(f"WITH {_AHU} SELECT net_id, newick, count(*) OVER (PARTITION BY newick) AS n_same FROM u")
def tree_isomorphism_classes(s, d):
    c = newick.canonical_newick(*fx.event_trees(s, d))
    return c.join(c.groupBy("newick").agg(F.count("*").alias("n_same")), "newick").select("net_id", "newick", "n_same")


#: Lattices are isomorphic if their regions have nations of the same numbers of suppliers.
_CANON = """k AS (SELECT net_id, r, n, count(*) AS k FROM fd0 GROUP BY net_id, r, n), t AS (SELECT net_id, r, string_agg(k::VARCHAR, ',' ORDER BY k) AS t FROM k GROUP BY net_id, r),
    canon AS (SELECT net_id, string_agg(r::VARCHAR || ':' || t, ';' ORDER BY r) AS c FROM t GROUP BY net_id)"""


@query(f"WITH {FD}, {_CANON} SELECT count(*) AS n, min(net_id) AS first FROM canon GROUP BY c")
def color_refinement(s, d):
    e = fx.lattices(s, d)
    return iso.signatures(e, fx.lattice_labels(s, d)).groupBy("signature").agg(F.count("*").alias("n"), F.min("net_id").alias("first")).select("n", "first")


@query(f"""WITH {FD}, {_CANON}, f AS (SELECT net_id AS b, min(net_id) OVER (PARTITION BY c) AS a FROM canon) SELECT a, b, count(DISTINCT node) AS n_nodes, true AS same_leaves FROM f JOIN (SELECT net_id, src AS node FROM fd UNION SELECT net_id, dst FROM fd) n ON n.net_id = b WHERE a <> b GROUP BY a, b""")
def isomorphism_mapping(s, d):
    """Every network mapped from the first of its class: as many nodes, leaves onto leaves of their label."""
    e, labels = cut(fx.lattices(s, d)), cut(fx.lattice_labels(s, d))
    sig = cut(iso.signatures(e, labels))
    pairs = sig.join(sig.groupBy("signature").agg(F.min("net_id").alias("a")), "signature").where("a <> net_id").select("a", F.col("net_id").alias("b"))
    found = iso.mappings(e, labels, cut(pairs))
    leaf = F.col("node_a") < 2 * fx.UNIT
    return found.groupBy("a", "b").agg(F.count_distinct("node_b").alias("n_nodes"), F.min(~leaf | (F.col("node_a") == F.col("node_b")) | (F.col("node_a") == 0)).alias("same_leaves"))


@query(f"WITH {FD}, {_CANON} SELECT x.net_id AS a, y.net_id AS b, x.c = y.c AS isomorphic FROM canon x JOIN canon y ON y.net_id = x.net_id + 1")
def network_isomorphism(s, d):
    e = cut(fx.lattices(s, d))
    ids = e.select("net_id").distinct()
    pairs = ids.select(F.col("net_id").alias("a"), (F.col("net_id") + 1).alias("b")).join(ids.select(F.col("net_id").alias("b")), "b", "left_semi").select("a", "b")
    return iso.isomorphic(e, cut(fx.lattice_labels(s, d)), pairs)


# ---- scanwidth -------------------------------------------------------------------------------

def _extension(e: DataFrame) -> DataFrame:
    """Children before parents: by layer from the bottom, then by id."""
    layer = F.when(F.col("node") == 0, 3).when(F.col("node") >= 4 * fx.UNIT, 2).when(F.col("node") >= 2 * fx.UNIT, 1).otherwise(0)
    w = Window.partitionBy("net_id").orderBy(layer, "node")
    return basic.nodes(e).select("net_id", "node", (F.row_number().over(w) - 1).alias("pos"))


@query(f"WITH {FD} SELECT DISTINCT net_id, net_id % 2 = 0 AS valid FROM fd")
def extension_valid(s, d):
    e = cut(fx.lattices(s, d))
    ext = _extension(e).withColumn("pos", F.when(F.col("net_id") % 2 == 1, -F.col("pos")).otherwise(F.col("pos")))
    return scanwidth.is_valid(e, ext)


# Regions come first, then nations: the part of a region grows nation by nation; suppliers and the root add nothing.
@query(f"""WITH {FD}, k AS (SELECT net_id, r, n, count(*) AS k FROM fd0 GROUP BY net_id, r, n), w AS (SELECT net_id, count(*) OVER (PARTITION BY net_id, r) AS c, sum(k - 1) OVER (PARTITION BY net_id, r ORDER BY n) AS g FROM k)
    SELECT net_id, max(c + greatest(g, 0))::BIGINT AS scanwidth FROM w GROUP BY net_id""")
def scanwidth_of_extension(s, d):
    e = cut(fx.lattices(s, d))
    return scanwidth.extension_widths(e, _extension(e)).groupBy("net_id").agg(F.max("sw").alias("scanwidth"))


@query(f"""WITH RECURSIVE {FE}, up AS (SELECT net_id, dst AS node, dst AS anc FROM fe UNION ALL SELECT DISTINCT net_id, 0::BIGINT, 0::BIGINT FROM fe UNION ALL SELECT up.net_id, up.node, fe.src FROM up JOIN fe ON fe.net_id = up.net_id AND fe.dst = up.anc),
    {DEGN.format(t='fe')} SELECT up.net_id, anc AS node, sum(indeg - outdeg) AS sw FROM up JOIN deg ON deg.net_id = up.net_id AND deg.node = up.node GROUP BY up.net_id, anc""")
def ext_tree_sw(s, d):
    e = cut(fx.event_trees(s, d)[0])
    tree = e.select("net_id", F.col("dst").alias("node"), F.col("src").alias("parent"))
    return scanwidth.tree_widths(e, tree)


@query()
def min_scanwidth(s, d):
    e = cut(fx.lattices(s, d))
    b = cut(structure.blocks(e))
    at = lambda c: b.select("net_id", F.col("node").alias(c), F.col("block").alias(f"b_{c}"))
    arcs = e.join(at("src"), ["net_id", "src"]).join(at("dst"), ["net_id", "dst"])
    # A bridge is a block of its own, named by its head (below zero: apart from the others).
    block = F.when(F.col("b_src") == F.col("b_dst"), F.col("b_src")).otherwise(-F.col("dst"))
    return scanwidth.min_scanwidth(arcs.select("net_id", block.alias("block"), "src", "dst"))


@query(f"WITH {FD} SELECT DISTINCT net_id, true AS valid, true AS same FROM fd")
def min_extension(s, d):
    """An extension of least scanwidth for every network: valid, and as wide as the optimum over blocks."""
    e = cut(fx.lattices(s, d))
    ext = cut(scanwidth.min_extensions(e))
    width = scanwidth.extension_widths(e, ext).groupBy("net_id").agg(F.max("sw").alias("w"))
    return scanwidth.is_valid(e, ext).join(width, "net_id").join(min_scanwidth(s, d), "net_id").select("net_id", "valid", (F.col("w") == F.col("scanwidth")).alias("same"))


@query(f"WITH {FD} SELECT DISTINCT net_id, true AS valid FROM fd")
def postorder_extension(s, d):
    e = cut(fx.lattices(s, d))
    return scanwidth.is_valid(e, scanwidth.postorder_extension(e))


# ---- containment -----------------------------------------------------------------------------

def _guests(e: DataFrame) -> DataFrame:
    return e.groupBy("net_id", "dst").agg(F.min("src").alias("src")).select("net_id", "src", "dst", F.lit(None).cast("double").alias("length"))


@query(f"WITH {FD} SELECT DISTINCT net_id, 'own' AS guest, true AS displayed FROM fd UNION ALL SELECT net_id, 'joined', count(DISTINCT r) <= 2 FROM fd0 GROUP BY net_id")
def tree_in_network(s, d):
    """Two guests for each lattice: a tree it displays, and one that joins its two smallest regions apart from the others (its trees are all stars)."""
    e, n = cut(fx.lattices(s, d)), cut(fx.lattice_labels(s, d))
    guest = rewrite.remove_upwards(_guests(e), basic.degree(_guests(e)).where("outdeg = 0").join(n.select("net_id", "node"), ["net_id", "node"], "left_anti").select("net_id", "node"))
    own = containment.contains(e, n, rewrite.suppress_unary(guest), n).withColumn("guest", F.lit("own"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy("net_id").orderBy("node"))).withColumn("m", F.count("*").over(Window.partitionBy("net_id")))
    inner = F.lit(50 * fx.UNIT)
    none = F.lit(None).cast("double")
    joined = ranked.select("net_id", F.when((F.col("k") <= 2) & (F.col("m") > 2), inner).otherwise(F.lit(0)).cast("long").alias("src"), F.col("node").alias("dst"), none.alias("length"))
    joined = joined.union(ranked.where("k = 1 and m > 2").select("net_id", F.lit(0).cast("long"), inner.cast("long"), none))
    return own.union(containment.contains(e, n, joined, n).withColumn("guest", F.lit("joined"))).select("net_id", "guest", "displayed")


# A star is displayed at the root if every set of its labels finds as many days (Hall), or below a day with enough events of each label.
@query("""WITH ty AS (SELECT event_type AS y, 1 << (row_number() OVER (ORDER BY event_type) - 1) AS bit FROM (SELECT DISTINCT event_type FROM events)),
    ev AS (SELECT user_id, ts::DATE AS day, event_id, event_type, bit FROM events JOIN ty ON y = event_type), dy AS (SELECT user_id, day, bit_or(bit) AS has FROM ev GROUP BY user_id, day),
    gu AS (SELECT user_id - 1 AS net_id, bit, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS k FROM ev) WHERE k = 1 AND user_id - 1 IN (SELECT user_id FROM events)),
    g AS (SELECT net_id, bit, count(*) AS c FROM gu GROUP BY net_id, bit), msk AS (SELECT unnest(range(1, (SELECT (sum(bit) + 1)::BIGINT FROM ty))) AS m),
    need AS (SELECT net_id, m, sum(c) AS c FROM g JOIN msk ON (m & bit) > 0 GROUP BY net_id, m), have AS (SELECT user_id AS net_id, m, count(*) AS c FROM dy JOIN msk ON (m & has) > 0 GROUP BY user_id, m),
    hall AS (SELECT need.net_id, bool_and(coalesce(have.c, 0) >= need.c) AS ok FROM need LEFT JOIN have ON have.net_id = need.net_id AND have.m = need.m GROUP BY need.net_id),
    cnt AS (SELECT user_id, day, bit, count(*) AS c FROM ev GROUP BY user_id, day, bit), one AS (SELECT g.net_id, dy.day, bool_and(coalesce(cnt.c, 0) >= g.c) AS ok FROM g JOIN dy ON dy.user_id = g.net_id LEFT JOIN cnt ON cnt.user_id = g.net_id AND cnt.day = dy.day AND cnt.bit = g.bit GROUP BY g.net_id, dy.day),
    any_day AS (SELECT net_id, bool_or(ok) AS ok FROM one GROUP BY net_id) SELECT net_id, hall.ok OR any_day.ok AS displayed FROM hall JOIN any_day USING (net_id)""")
def tree_in_tree(s, d):
    """The guest of each user: a star of the first event of every day of the next user."""
    e, n = fx.event_trees(s, d)
    first = n.join(e.select("net_id", F.col("dst").alias("node"), "src"), ["net_id", "node"]).groupBy("net_id", "src").agg(F.min(F.struct("node", "label")).alias("m"))
    star = first.select((F.col("net_id") - 1).alias("net_id"), "m.node", "m.label").join(e.select("net_id").distinct(), "net_id", "left_semi")
    guest = cut(star)
    arcs = guest.select("net_id", F.lit(0).cast("long").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("length"))
    hosts = guest.select("net_id").distinct()
    return containment.contains(e.join(hosts, "net_id", "left_semi"), n.join(hosts, "net_id", "left_semi"), arcs, guest)


@query()
def matching_max(s, d):
    line = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right")).distinct()
    return containment.matchings(line)


# ---- generators and scalars ------------------------------------------------------------------

@query("SELECT k AS net_id, 2 * 10 + 2 * 40 - 1 AS n_nodes, 10 AS n_retis, 40 AS n_leaves, 2 * 40 + 3 * 10 - 2 AS n_edges FROM range(50) t(k)")
def gen_networks(s, d):
    e = generate.networks(s, 50, 10, 40, seed=1)
    deg = basic.degree(cut(e))
    c = deg.groupBy("net_id").agg(F.count("*").alias("n_nodes"), F.sum((F.col("indeg") == 2).cast("int")).alias("n_retis"), F.sum((F.col("outdeg") == 0).cast("int")).alias("n_leaves"), F.sum("outdeg").alias("n_edges"))
    return c


@query("SELECT k AS net_id, 20 + 30 + 5 + 3 AS n_nodes, 20 + 30 - 1 + 5 + 3 + 8 AS n_edges, 3 AS n_retis, 8 + 3 AS retis_in, false AS cyclic FROM range(50) t(k)")
def gen_random_edges(s, d):
    """Trees of 20 inner nodes and 30 leaves with 8 more arcs, 5 new tails and 3 new heads."""
    e = cut(generate.networks_with_edges(s, 50, 20, 30, 5, 3, 8, seed=2))
    deg = basic.degree(e)
    two = F.col("indeg") > 1
    found = deg.groupBy("net_id").agg(F.count("*").alias("n_nodes"), F.sum("outdeg").alias("n_edges"), F.sum(two.cast("int")).alias("n_retis"), F.sum(F.when(two, F.col("indeg"))).alias("retis_in"))
    cyclic = structure.cyclic_nodes(e).select("net_id").distinct().withColumn("cyclic", F.lit(True))
    return found.join(cyclic, "net_id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


@query("SELECT s_suppkey AS k, (2 * s_suppkey + 101 - 2 * s_suppkey + 1) // 2 AS leaves, 2 * s_suppkey + 2 * 7 - 1 AS nodes, (2 * s_suppkey + 51 - 2 * 7 + 1) // 2 AS retis FROM supplier")
def gen_counts(s, d):
    k = F.col("s_suppkey")
    return fx.table(s, d, "supplier").select(k.alias("k"), scalar.leaves_from(2 * k + 101, k).alias("leaves"), scalar.nodes_from(k, F.lit(7)).alias("nodes"), scalar.reticulations_from(2 * k + 51, F.lit(7)).alias("retis"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey < 26 THEN chr((97 + o_orderkey)::INT) WHEN o_orderkey < 676 THEN chr((97 + o_orderkey // 26)::INT) || chr((97 + o_orderkey % 26)::INT)
    WHEN o_orderkey < 17576 THEN chr((97 + o_orderkey // 676)::INT) || chr((97 + o_orderkey // 26 % 26)::INT) || chr((97 + o_orderkey % 26)::INT)
    ELSE chr((97 + o_orderkey // 17576)::INT) || chr((97 + o_orderkey // 676 % 26)::INT) || chr((97 + o_orderkey // 26 % 26)::INT) || chr((97 + o_orderkey % 26)::INT) END AS name,
    CASE WHEN o_orderkey <= 0 THEN 0 ELSE length(bin(o_orderkey)) - 1 END AS log2, bit_count(o_orderkey) AS ones FROM orders""")
def scalar_functions(s, d):
    k = F.col("o_orderkey")
    return fx.table(s, d, "orders").select(k.alias("k"), scalar.taxon_name(k).alias("name"), scalar.integer_log(k).alias("log2"), F.bit_count(k).alias("ones"))


@query("""SELECT o_orderkey AS k, o_orderkey AS back, list_filter(range(64), lambda i: (o_orderkey >> i::BIGINT) & 1 = 1)[2] AS second_set, list_filter(range(63), lambda i: (o_orderkey >> i::BIGINT) & 1 = 0)[1] AS first_unset,
    o_orderkey & (o_orderkey - 1) AS less_lowest, o_orderkey | (o_orderkey + 1) AS more_lowest, (((o_orderkey << 5) | (o_orderkey >> 27)) & 4294967295)::BIGINT AS turned, o_orderkey AS turned_back FROM orders""")
def bit_functions(s, d):
    k = F.col("o_orderkey")
    return fx.table(s, d, "orders").select(
        k.alias("k"), scalar.unscramble(scalar.scramble(k)).alias("back"), scalar.kth_set_bit(k, 1).cast("long").alias("second_set"), scalar.kth_unset_bit(k, 0).cast("long").alias("first_unset"),
        scalar.clear_kth_set(k, 0).alias("less_lowest"), scalar.set_kth_unset(k, 0).alias("more_lowest"), scalar.rotate_left_32(k, 5).alias("turned"), scalar.rotate_right_32(scalar.rotate_left_32(k, 5), 5).alias("turned_back"))


@query("""SELECT p_partkey AS k, list_filter(string_split(p_type, ' '), lambda x: x <> '') AS tokens, p_size * 100 + p_partkey % 100 AS cell, (greatest(p_size, 60) * (greatest(p_size, 60) - 1) // 2 + least(p_size, 60))::BIGINT AS pair FROM part""")
def string_and_index_functions(s, d):
    size = F.col("p_size").cast("long")
    return fx.table(s, d, "part").select(F.col("p_partkey").alias("k"), scalar.tokens(F.col("p_type"), " ").alias("tokens"),
                                         scalar.linear_index(size, F.col("p_partkey") % 100, F.lit(100)).alias("cell"), scalar.triangle_index(size, F.lit(60)).alias("pair"))
