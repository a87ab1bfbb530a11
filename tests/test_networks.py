"""Golden cases, and properties on random networks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from reticula.operators import basic, containment, iso, lca, order, recursion, rewrite, scanwidth, sets, structure
from reticula.plans.model import Network, validate
from reticula.sources import generate
from reticula.sources.newick import NewickError, ascii_tree, format_network, parse_any, parse_edgelist, parse_newick

EDGES = "net_id long, src long, dst long, length double"


def frame(spark, nets):
    return spark.createDataFrame([(k, a, b, None) for k, arcs in enumerate(nets) for a, b in arcs], EDGES)


def random_nets(n=12, seed=1):
    r = random.Random(seed)
    return [generate.random_binary_network(r.randint(0, 3), r.randint(2, 5), r) for _ in range(n)]


def below(arcs, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for a, b in arcs:
            if a == v and b not in seen and b != without:
                seen.add(b)
                todo.append(b)
    return seen


# ---- text ------------------------------------------------------------------------------------

@pytest.mark.parametrize(("text", "nodes", "arcs", "retis"), [
    ("(a,(((b)#H1,(c)#H2),(#H1,#H2)),d);", 10, 11, 2), ("((a,(((b)#H1,(c)#H2),(#H1,#H2))),d);", 11, 12, 2), ("((a,b),(c,d));", 7, 6, 0),
    ("a;", 1, 0, 0), ("", 0, 0, 0), ("(((a)#LGT1,b),(#R1,c));", 7, 7, 1), ("((a)x#H1,#H1);", 3, None, None)])
def test_newick_shapes(text, nodes, arcs, retis):
    if arcs is None:
        with pytest.raises(NewickError):
            parse_newick(text)
        return
    e, labels = parse_newick(text)
    assert len(e) == arcs and len({v for x in e for v in x[:2]} | set(labels)) == nodes
    heads = [b for _, b, _ in e]
    assert sum(heads.count(v) > 1 for v in set(heads)) == retis


@pytest.mark.parametrize("text", ["(a,b)", "(a,b));", "((a,b);", "(#H1,(x)#H1,#H1);", "((a)#H,#H);", "(a,b); x", "(a:x,b);", "((a)x#H1,(b)#H1);", "(((a)x#H1,b),(y#H1,c));"])
def test_newick_errors(text):
    with pytest.raises(NewickError):
        parse_newick(text)


def test_newick_details():
    e, labels = parse_newick("((a:1.5,b:2e-1):0.5,c);")
    assert sorted(x for *_, x in e if x is not None) == [0.2, 0.5, 1.5]
    assert sorted(labels.values()) == ["a", "b", "c"]
    assert "x" in parse_newick("(((a)x#H1,b),(#H1,c));")[1].values()
    with pytest.raises(NewickError):
        parse_newick("(a,b,c);", allow_non_binary=False)
    with pytest.raises(NewickError):
        parse_newick("(((a,b)#H1,c),(#H1,d));", allow_junctions=False)
    assert parse_edgelist("r a\nr b")[1] == {0: "r", 1: "a", 2: "b"}
    assert len(parse_any("r a 2\n\nr b 3\n")[0]) == 2
    deep = "(" * 5000 + "a" + ")" * 5000 + ";"
    assert len(parse_newick(deep)[0]) == 5000


def test_round_trip_of_random_networks():
    for k, arcs in enumerate(random_nets(60, 3)):
        names = {v: f"t{v}" for v in {b for _, b in arcs} if v not in {a for a, _ in arcs}}
        e, labels = parse_newick(format_network(arcs, names, 0))
        assert iso.isomorphic_kernel(arcs, names, [x[:2] for x in e], labels), k
        assert ascii_tree(arcs, names, 0).count("(R") == sum(1 for v in {b for _, b in arcs} if sum(b == v for _, b in arcs) > 1)


# ---- structure ---------------------------------------------------------------------------------

def test_validate(spark):
    rows = [(0, 0, 1), (0, 2, 1), (1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 1, 2), (2, 2, 1), (3, 0, 1)]
    e = spark.createDataFrame([(*x, None) for x in rows], EDGES)
    got = {(r.net_id, r.rule) for r in validate(Network.from_edges(e)).collect()}
    assert got == {(0, "several roots"), (1, "no root"), (1, "cycle"), (2, "cycle")}


def test_structure_against_brute_force(spark):
    nets = random_nets()
    e = frame(spark, nets)
    bridges, dom = {tuple(r) for r in structure.bridges(e).collect()}, {tuple(r) for r in structure.dominators(e).collect()}
    paths = {(r.net_id, r.node): r.n_paths for r in recursion.path_counts(e).collect()}
    closure = {tuple(r) for r in recursion.closure(e).collect()}
    for k, arcs in enumerate(nets):
        nodes = {v for a in arcs for v in a}
        for a, b in arcs:
            rest = [x for x in arcs if x != (a, b)]
            cut_off = b not in below(rest + [(y, x) for x, y in rest], a)
            assert ((k, a, b) in bridges) == cut_off
        for v in nodes:
            for x in nodes:
                lost = x == v or v == 0 or x not in below(arcs, 0, v)
                assert ((k, x, v) in dom) == lost
                assert ((k, x, v) in closure) == (x in below(arcs, v))

        def count(v, arcs=arcs):
            return 1 if v == 0 else sum(count(a) for a, b in arcs if b == v)
        assert all(paths[k, v] == count(v) for v in nodes)


def test_lca_golden(spark):
    ids = {c: k for k, c in enumerate("abcdefghi")}
    arcs = [(ids[x[0]], ids[x[1]]) for x in ("ab", "af", "bc", "bd", "be", "fg", "fi", "gh")]
    e = frame(spark, [arcs])
    pairs = spark.createDataFrame([(0, ids[x[0]], ids[x[1]]) for x in ("aa", "bf", "ce", "hi")], "net_id long, a long, b long")
    for got in (lca.lca(recursion.tree_closure(e), pairs), lca.lca_by_tour(order.orders(e), pairs)):
        assert {(r.a, r.b): "abcdefghi"[r.lca] for r in got.collect()} == {(0, 0): "a", (1, 5): "a", (2, 4): "b", (7, 8): "f"}


def test_rmq_golden(spark):
    arrays = [[1] * 6, [3, 1, 2, 1, 4, 5], [10, 8, 9, 2, 4, 5, 1, 16, 4, 7], [1, 2, 1, 2, 1, 0]]
    seq = spark.createDataFrame([(k, i, v) for k, a in enumerate(arrays) for i, v in enumerate(a)], "seq_id long, i long, val long")
    q = spark.createDataFrame([(k, lo, hi) for k, a in enumerate(arrays) for lo in range(len(a)) for hi in range(lo + 1, len(a) + 1)], "seq_id long, lo long, hi long")
    for got in (order.rmq(order.sparse_table(seq), q), order.block_rmq(seq, q, 3), order.all_intervals(seq)):
        rows = got.collect()
        assert len(rows) == q.count()
        for r in rows:
            part = arrays[r.seq_id][r.lo:r.hi]
            assert r.val == min(part) and r.arg == r.lo + part.index(min(part))


def test_all_intervals_on_request(spark):
    nan = float("nan")
    arrays = {0: [(0, 2.0), (1, None), (2, nan), (3, None)], 1: [(4, nan), (7, 1.5), (8, 1.5), (20, -1.0)], 2: [(0, 5.0)]}
    seq = spark.createDataFrame([(k, i, v) for k, a in arrays.items() for i, v in a], "seq_id long, i long, val double")
    asked = [(0, 0, 1), (0, 0, 2), (0, 2, 3), (0, 2, 4), (0, 0, 5), (0, 1, 1), (1, 4, 5), (1, 4, 9), (1, 7, 9), (1, 7, 9), (1, 5, 9), (1, 4, 21), (2, 0, 1), (3, 0, 1), (None, 0, 1)]
    got = order.all_intervals(seq, spark.createDataFrame(asked, "seq_id long, lo long, hi long")).collect()
    # Null is below all, NaN above; gaps and unknown ends give no row, a repeated query repeats.
    want = [(0, 0, 1, 2.0, 0), (0, 0, 2, None, 1), (0, 2, 3, nan, 2), (0, 2, 4, None, 3), (1, 4, 5, nan, 4), (1, 4, 9, 1.5, 7), (1, 7, 9, 1.5, 7), (1, 7, 9, 1.5, 7), (1, 4, 21, -1.0, 20), (2, 0, 1, 5.0, 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_all_intervals_sends_answers_only(spark):
    n = 1500
    seq = spark.range(n).select(F.lit(0).cast("long").alias("seq_id"), F.col("id").alias("i"), ((F.col("id") * 7919) % 1009).alias("val"))
    plan = order.all_intervals(seq, spark.createDataFrame([(0, 10, n), (0, 0, n)], "seq_id long, lo long, hi long"))
    assert sorted((r.lo, r.hi, r.val, r.arg) for r in plan.collect()) == [(0, n, 0, 0), (10, n, 0, 1009)]
    # Of the 1,125,750 intervals none but the two answers reaches a join or a sort.
    nodes, sizes = [plan._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        metric = node.metrics().get("numOutputRows")
        sizes += [metric.get().value()] if metric.isDefined() else []
        more = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        nodes += more + [node.children().apply(k) for k in range(node.children().size())]
    assert sizes and max(sizes) < 2 * n


# ---- isomorphism -----------------------------------------------------------------------------

def cycle_network(cycles):
    arcs, reti = [], 10
    for c in cycles:
        for i, v in enumerate(c):
            arcs += [(v, reti), (c[(i + 1) % len(c)], reti)]
            reti += 1
    return [(0, v) for c in cycles for v in c] + arcs


def test_isomorphism(spark):
    hexagon, triangles = cycle_network([[1, 2, 3, 4, 5, 6]]), cycle_network([[1, 2, 3], [4, 5, 6]])
    assert not iso.isomorphic_kernel(hexagon, {}, triangles, {})
    r = random.Random(7)
    for arcs in random_nets(30, 5):
        nodes = sorted({v for a in arcs for v in a})
        to = dict(zip(nodes, r.sample(nodes, len(nodes)), strict=True))
        assert iso.isomorphic_kernel(arcs, {}, [(to[a], to[b]) for a, b in arcs], {})
    e = frame(spark, [hexagon, triangles, hexagon])
    labels = spark.createDataFrame([], "net_id long, node long, label string")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert {(x.a, x.b): x.isomorphic for x in iso.isomorphic(e, labels, pairs).collect()} == {(0, 1): False, (0, 2): True}
    x, y = parse_newick("((a,b)x,c);"), parse_newick("((a,b)y,c);")
    both = frame(spark, [[z[:2] for z in n[0]] for n in (x, y)])
    names = spark.createDataFrame([(k, v, t) for k, n in enumerate((x, y)) for v, t in n[1].items()], "net_id long, node long, label string")
    one = spark.createDataFrame([(0, 1)], "a long, b long")
    assert iso.isomorphic(both, names, one, (iso.LEAF,)).first().isomorphic and not iso.isomorphic(both, names, one).first().isomorphic


# ---- scanwidth and containment -----------------------------------------------------------------

def test_scanwidth():
    assert scanwidth.best_extension([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])[0] == 2
    assert scanwidth.best_extension([(0, 1), (0, 2), (1, 3)])[0] == 1
    r = random.Random(4)
    for _ in range(25):
        arcs = generate.random_binary_network(r.randint(0, 1), r.randint(2, 3), r)
        if len({v for a in arcs for v in a}) > 8:
            continue
        best, ext = scanwidth.best_extension(arcs)
        assert best == scanwidth.brute_force(arcs) == max(w for *_, w in scanwidth.tree_and_widths(arcs, ext))
        assert scanwidth.best_extension(scanwidth.contract_unary(arcs))[0] == best


def test_scanwidth_tables_agree(spark):
    nets = [n for n in random_nets(8, 11) if n]
    e = frame(spark, nets)
    ext = [(k, p, v) for k, n in enumerate(nets) for p, v in enumerate(scanwidth.best_extension(n)[1])]
    positions = spark.createDataFrame(ext, "net_id long, pos long, node long")
    assert {r.valid for r in scanwidth.is_valid(e, positions).collect()} == {True}
    widths = scanwidth.extension_widths(e, positions)
    by_tree = scanwidth.tree_widths(e, widths.select("net_id", "node", "parent"))
    assert sorted((r.net_id, r.node, r.sw) for r in widths.collect()) == sorted((r.net_id, r.node, r.sw) for r in by_tree.collect())


def labels_of(text):
    e, n = parse_newick(text)
    return [x[:2] for x in e], n


@pytest.mark.parametrize(("host", "guest", "shown"), [
    ("((a,(((b)#H1,(c)#H2),(#H1,#H2))),d);", "((a,b),(c,d));", False), ("((a,(((b)#H1,(c)#H2),(#H1,#H2))),d);", "(((b,c),a),d);", True),
    ("((((a,b),(c,d)),(e,d)),((a,b),(e,d)));", "(e,((a,c),(b,d)));", False), ("((a,b),c);", "(a,b,c);", False),
    ("((a,b),(c,x));", "((a,b),c);", True), ("((a,b),c);", "((a,b),z);", False), ("(a,b,c);", "((a,b),c);", False)])
def test_containment_golden(host, guest, shown):
    assert containment.network_displays(*labels_of(host), *labels_of(guest)) == shown


def test_containment_against_brute_force():
    r = random.Random(12)
    seen = set()
    for _ in range(150):
        host = generate.random_binary_network(r.randint(0, 3), r.randint(3, 5), r)
        tails = {a for a, _ in host}
        leaves = sorted({b for _, b in host} - tails)
        names = {v: f"t{k}" for k, v in enumerate(leaves)}
        guest = generate.random_tree(len(leaves) - 1, len(leaves), r)
        tips = sorted({b for _, b in guest} - {a for a, _ in guest})
        tags = dict(zip(tips, r.sample(sorted(names.values()), len(tips)), strict=True))
        want = containment.brute_force(host, names, guest, tags)
        assert containment.network_displays(host, names, guest, tags) == want
        seen.add(want)
        tree = generate.random_tree(3, 4, r)
        tip = sorted({b for _, b in tree} - {a for a, _ in tree})
        own = {v: f"t{k}" for k, v in enumerate(tip)}
        grown = generate.add_random_arcs(tree, 2, r)
        assert containment.network_displays(grown, own, tree, own)  # a tree with more arcs displays it
    assert seen == {True, False}


# ---- rewrites, sets, generators ----------------------------------------------------------------

def test_rewrites(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 2.0), (0, 2, 3, 3.0), (0, 3, 4, 4.0), (0, 3, 5, 5.0)], EDGES)
    got = sorted(tuple(r) for r in rewrite.suppress_unary(e).collect())
    assert got == [(0, 0, 3, 6.0), (0, 3, 4, 4.0), (0, 3, 5, 5.0)]
    gone = spark.createDataFrame([(0, 4), (0, 5)], "net_id long, node long")
    assert rewrite.remove_upwards(e, gone).count() == 0
    more = rewrite.add_children(e, gone)
    assert sorted((r.src, r.dst) for r in more.collect())[-2:] == [(4, 6), (5, 7)]
    assert basic.incident_with(F.lit(3)) is not None and e.where(basic.incident_with(F.lit(3))).count() == 3


def test_down_sets():
    children = {0: [1, 2], 1: [3], 2: [3], 3: []}
    got = list(sets.down_sets(children))
    assert len(got) == len(set(got)) == 6
    order_, seen = list(children), set()
    for s in got:
        chosen = [v for k, v in enumerate(order_) if s >> k & 1]
        assert all(c in chosen for v in chosen for c in children[v])
        seen.add(s)
    assert len(list(sets.subsets([1, 2, 3]))) == 8


def test_generators(spark):
    r = random.Random(1)
    for retis in range(5):
        arcs = generate.random_binary_network(retis, 6, r)
        deg = {v: (sum(b == v for _, b in arcs), sum(a == v for a, _ in arcs)) for x in arcs for v in x}
        assert sum(i == 2 for i, _ in deg.values()) == retis and sum(o == 0 for _, o in deg.values()) == 6
        assert len(deg) == 2 * retis + 2 * 6 - 1
    assert generate.numbers() == (49, 10, 40) and generate.numbers(r=10, leaves=40) == (49, 10, 40)
    with pytest.raises(ValueError):
        generate.numbers(n=10, r=1)
    assert len(generate.birth_process(7, r)) == 12
    a, b = (sorted(map(tuple, generate.networks(spark, 3, 2, 4, seed=5).collect())) for _ in range(2))
    assert a == b
    assert containment.maximum_matching({1: [5], 2: [5, 6], 3: [6, 7]}) == {1: 5, 2: 6, 3: 7}


def test_stream(spark, tmp_path):
    from reticula.sources.newick import edges_of
    from reticula.streaming.newick_stream import newick_stream, run_per_batch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nw").write_text("((a,b),c);\n(a,b);\n")
    seen = []
    q = run_per_batch(newick_stream(spark, str(tmp_path / "in")), lambda df, k: seen.append(edges_of(df).count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == 6


def test_command_line(tmp_path, capsys):
    from reticula.__main__ import main

    one, two = tmp_path / "a.nw", tmp_path / "b.txt"
    one.write_text("((a,b),c);\n(c,(b,a));\n")
    two.write_text("r x\nr y")
    assert main(["iso", str(one)]) == 0 and main(["iso", str(one), str(two)]) == 0
    assert main(["tc", "-v", "-r", "3", "5", "2"]) == 0 and main(["tc", str(one)]) == 0
    assert main(["scanwidth", str(one)]) == 0 and "scanwidth 1" in capsys.readouterr().out
    assert main(["gen", "-n", "19", "-r", "2", str(tmp_path / "g.nw")]) == 0 and main(["gen", "-a", "-r", "1", "-l", "3", str(tmp_path / "g.nw")]) == 0
    assert len((tmp_path / "g.nw").read_text().splitlines()) == 2
    assert main(["branch-len", str(two)]) == 0 and main(["node-data", str(one)]) == 0


# ---- depth, cycles, size ---------------------------------------------------------------------

def test_deep_trees_and_cycles_end(spark):
    n = 1000
    caterpillar = [(2 * i, 2 * i + 1) for i in range(n)] + [(2 * i, 2 * i + 2) for i in range(n)]
    e = frame(spark, [caterpillar])
    got = {r.node: r for r in order.orders(e).collect()}
    assert len(got) == 2 * n + 1 and got[0].size == 2 * n + 1 and got[2 * n].depth == n
    # Children by id: the leaf 2i + 1 comes before the inner node 2i + 2.
    assert all(got[2 * i].pre == 2 * i and got[2 * i + 1].pre == 2 * i + 1 for i in range(n))
    assert got[0].post == 2 * n and got[2 * n].post == n
    cyclic = frame(spark, [[(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 1)]])
    for run in (recursion.tree_closure, recursion.tree_facts, recursion.path_counts):
        with pytest.raises(ValueError, match="cycle|parents"):
            run(cyclic)
    for run in (recursion.tree_closure, recursion.tree_facts, rewrite.suppress_unary):
        with pytest.raises(ValueError, match="cycle"):
            run(cyclic.where("net_id = 0"))
    assert {r.net_id for r in structure.cyclic_nodes(cyclic).collect()} == {0, 1}


def test_matching_of_long_chains():
    options = {i: [i, i + 1] for i in range(4000)} | {4000: [0]}
    assert len(containment.maximum_matching(options)) == 4001
    rng = random.Random(3)

    def best(left, used, options):
        if not left:
            return 0
        v, *rest = left
        return max([best(rest, used, options)] + [1 + best(rest, used | {w}, options) for w in options[v] if w not in used])

    for _ in range(100):
        options = {v: sorted(rng.sample(range(7), rng.randint(0, 3))) for v in range(7)}
        found = containment.maximum_matching(options)
        assert all(w in options[v] for v, w in found.items()) and len(set(found.values())) == len(found) == best(list(options), frozenset(), options)


def test_scanwidth_without_a_limit():
    rng = random.Random(5)
    for k in range(60):
        arcs = generate.random_binary_network(rng.randint(0, 2), rng.randint(2, 3), rng)
        if len({v for a in arcs for v in a}) <= 8:
            width, order_ = scanwidth.min_extension(arcs)
            assert width == scanwidth.brute_force(arcs) == max(w for *_, w in scanwidth.tree_and_widths(arcs, order_))
    for seed in range(4):
        arcs = generate.random_binary_network(10, 40, random.Random(seed))  # the default of the generator: 99 nodes
        width, order_ = scanwidth.min_extension(arcs)
        position = {v: i for i, v in enumerate(order_)}
        assert len(position) == 99 and all(position[b] < position[a] for a, b in arcs)
        assert width == max(w for *_, w in scanwidth.tree_and_widths(arcs, order_)) <= max(w for *_, w in scanwidth.tree_and_widths(arcs, scanwidth.any_extension(arcs)))
        assert width == max(scanwidth.best_extension(b)[0] for b in scanwidth.split_blocks(arcs))


def test_isomorphism_gives_a_mapping():
    rng = random.Random(8)
    for _ in range(20):
        arcs = generate.random_binary_network(3, 6, rng)
        nodes = sorted({v for a in arcs for v in a})
        names = dict(zip(nodes, rng.sample(range(100, 200), len(nodes)), strict=True))
        other = [(names[a], names[b]) for a, b in arcs]
        found = iso.isomorphism(arcs, {}, other, {})
        assert found and {(found[a], found[b]) for a, b in arcs} == set(other) and len(set(found.values())) == len(nodes)
    assert iso.isomorphism([(0, 1)], {1: "a"}, [(0, 1)], {1: "b"}) is None


def test_colours_of_a_long_path(spark):
    e = frame(spark, [[(i, i + 1) for i in range(12)], [(i, i + 1) for i in range(12)]])
    labels = spark.createDataFrame([], "net_id long, node long, label string")
    colours = iso.refine(e, iso.seed_colours(e, labels))
    assert colours.where("net_id = 0").select("colour").distinct().count() == 13


def test_lengths_survive_and_bad_ones_are_errors(spark):
    from reticula.sources import newick

    arcs = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    text = format_network(arcs, {4: "x"}, 0, {a: 0.25 * (k + 1) for k, a in enumerate(arcs)})
    assert sorted(x for _, _, x in parse_newick(text)[0]) == [0.25, 0.5, 0.75, 1.0, 1.25]
    rows = spark.createDataFrame([(1, "a b 1.5"), (2, "a b c d"), (3, "a b long")], "net_id long, value string")
    errors = newick.errors_of(newick.parse_table(rows, parse_edgelist)).collect()
    assert {r.net_id for r in errors} == {2, 3}


def test_remove_node_and_set_root(spark):
    e = frame(spark, [[(0, 1), (1, 2), (1, 3)], [(0, 1), (0, 2)], [(5, 6), (6, 7)]])
    gone = spark.createDataFrame([(0, 1), (1, 0), (2, 5)], "net_id long, node long")
    got = {(r.net_id, r.src, r.dst) for r in rewrite.remove_node(e, gone).collect()}
    assert got == {(0, 0, 2), (0, 0, 3), (1, 0, 1), (1, 0, 2), (2, 6, 7)}  # a root with two children stays
    turned = rewrite.set_root(e, spark.createDataFrame([(0, 2), (2, 7)], "net_id long, node long"))
    assert {(r.net_id, r.src, r.dst) for r in turned.collect()} == {(0, 2, 1), (0, 1, 0), (0, 1, 3), (1, 0, 1), (1, 0, 2), (2, 7, 6), (2, 6, 5)}


def test_taxon_names_of_any_length(spark):
    from reticula.functions import scalar

    def name(x):
        return (name(x // 26) if x >= 26 else "") + chr(97 + x % 26)

    keys = [0, 25, 26, 27, 675, 676, 17575, 17576, 456975, 456976, 456977, 899999, 11881375, 11881376, 2**32 - 1]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", scalar.taxon_name(F.col("k")).alias("name")).collect()
    assert {r.k: r["name"] for r in got} == {k: name(k) for k in keys}


def test_scalars_of_bits_and_maps(spark):
    from pyspark.sql import functions as F

    from reticula.functions import scalar

    df = spark.createDataFrame([(0,), (1,), (-1,), (2**62 + 5,), (-2**63,)], "x long")
    x = F.col("x")
    for r in df.select("x", scalar.unscramble(scalar.scramble(x)).alias("y"), scalar.kth_set_bit(x, 1).alias("a"), scalar.kth_unset_bit(x, 0).alias("b")).collect():
        bits = [r.x >> k & 1 for k in range(64)]
        ones, zeros = [k for k in range(64) if bits[k]], [k for k in range(64) if not bits[k]]
        assert r.y == r.x and r.a == (ones[1] if len(ones) > 1 else None) and r.b == (zeros[0] if zeros else None)
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("m"))
    r = m.select(scalar.decrease_or_remove(F.col("m"), F.lit("a")).alias("p"), scalar.decrease_or_remove(F.col("m"), F.lit("b")).alias("q")).first()
    assert r.p == {"b": 2} and r.q == {"a": 1, "b": 1}
    share = spark.range(10_000).agg(F.avg(scalar.coin(F.col("id"), 3).cast("int")), F.avg(scalar.die(F.col("id"), 3, 6))).first()
    assert abs(share[0] - 0.5) < 0.03 and abs(share[1] - 2.5) < 0.1
    s = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"))
    assert tuple(spark.range(1).select(scalar.pair_sum(s, s).alias("s")).first().s) == (2, 4)


# ---- traversal orders, component paths, branching --------------------------------------------

def visits_of(arcs, kinds):
    children = {}
    for a, b in sorted(arcs):
        children.setdefault(a, []).append(b)
    out = []

    def walk(v):
        out.append((v, "pre"))
        for k, c in enumerate(children.get(v, [])):
            if k:
                out.append((v, "in"))
            walk(c)
        out.append((v, "post"))

    walk((set(children) - {b for _, b in arcs}).pop())
    return [(v, k) for v, k in out if k in kinds]


def test_visits_in_any_mix_of_orders(spark):
    r = random.Random(21)
    trees = [generate.random_tree(k, k + 1 + k % 3, r) for k in range(2, 9)]
    ordered = order.orders(frame(spark, trees)).cache()
    for kinds in (("pre",), ("in",), ("post",), ("pre", "post"), ("pre", "in", "post")):
        got = {}
        for row in sorted(order.visits(ordered, kinds).collect()):
            got.setdefault(row.net_id, []).append((row.node, row.kind))
        assert got == {k: v for k, t in enumerate(trees) if (v := visits_of(t, kinds))}


def test_dfs_arcs_and_first_appearance(spark):
    nets = [n for n in random_nets(10, 22) if n]
    got = {}
    for row in sorted(order.dfs_arcs(frame(spark, nets)).collect(), key=lambda x: (x.net_id, x.nr)):
        got.setdefault(row.net_id, []).append((row.src, row.dst))
    for k, arcs in enumerate(nets):
        want, seen = [], set()

        def walk(v):
            seen.add(v)
            for w in sorted(b for a, b in arcs if a == v):  # noqa: B023
                if w not in seen:  # noqa: B023
                    want.append((v, w))  # noqa: B023
                    walk(w)  # noqa: B023

        walk((({a for a, _ in arcs}) - {b for _, b in arcs}).pop())
        assert got[k] == want
    rows = [(k, a, b, pos) for k, arcs in enumerate(nets) for pos, (a, b) in enumerate(arcs)]
    ids = {(x.net_id, x.node): x.id for x in order.first_appearance(spark.createDataFrame(rows, "net_id long, src long, dst long, pos long")).collect()}
    for k, arcs in enumerate(nets):
        flat = list(dict.fromkeys(v for a in arcs for v in a))
        assert [ids[k, v] for v in flat] == list(range(len(flat)))
    assert order.dfs_arcs(frame(spark, [])).count() == 0 == order.first_appearance(spark.createDataFrame([], "net_id long, src long, dst long, pos long")).count()


def test_component_paths_and_branch_counts(spark):
    r = random.Random(23)
    nets = [generate.random_binary_network(r.randint(1, 6), r.randint(2, 6), r) for _ in range(40)]
    edges = frame(spark, nets).cache()
    comp = {}
    for row in structure.tree_components(edges).collect():
        comp.setdefault(row.net_id, {})[row.node] = row.comp
    paths = {(x.net_id, x.src, x.dst): x.n_paths for x in structure.component_paths(edges).collect()}
    state = {(x.net_id, x.comp): (x.half_eligible, x.eligible) for x in structure.eligible_components(edges).collect()}
    counts = {(x.net_id, x.node): tuple(x)[2:] for x in structure.branch_counts(edges).collect()}
    want_paths, want_state, want_counts, some_best = {}, {}, {}, 0
    for k, arcs in enumerate(nets):
        own, down, up = comp[k], {}, {}
        for a, b in arcs:
            down.setdefault(a, []).append(b)
            up.setdefault(b, []).append(a)

        def count(u, v):
            return 1 if u == v else sum(count(c, v) for c in down.get(u, []))  # noqa: B023

        def met(v):
            return set().union(*({own[p]} if p in own else met(p) for p in up.get(v, [])))  # noqa: B023

        def sees(v):
            found = {own[v]} if v in own else met(v)  # noqa: B023
            return found.pop() if len(found) == 1 else None

        tops = set(own.values())
        for u in tops:
            below = {v: n for v in tops - {u} if (n := count(u, v))}
            want_paths |= {(k, u, v): n for v, n in below.items()}
            half = all(n == 1 for n in below.values())
            tips = [v for v in up if v not in down and len(up[v]) == 1]
            want_state[k, u] = (half, half and any(met(v) == {u} for v in tips))
        inner = set().union(*(met(v) for v in tops)) if tops else set()
        rows = {}
        for v in up:
            if len(up[v]) > 1:
                seen = [sees(p) for p in up[v]]
                only = down.get(v, [])
                able = len(only) == 1 and only[0] not in down and len(up[only[0]]) == 1 and sees(v) is None
                rows[v] = (seen.count(None), sum(c in inner for c in seen if c is not None), sum(c not in inner for c in seen if c is not None), able)
        best = min(((x[:3], v) for v, x in rows.items() if x[3]), default=(None, None))[1]
        some_best += best is not None
        want_counts |= {(k, v): (*x, v == best) for v, x in rows.items()}
    assert paths == want_paths and state == want_state and counts == want_counts
    assert some_best and any(x[0] for x in counts.values()) and any(x[2] for x in counts.values())


@pytest.mark.parametrize(("tree_nodes", "retis", "count"), [(0, 3, 3), (3, 3, 3), (2, 1, 4), (0, 1, 3), (5, 2, 6)])
def test_random_edges_with_numbers_of_new_nodes(tree_nodes, retis, count):
    r = random.Random(24)
    for _ in range(20):
        old = generate.random_tree(6, 9, r)
        new = generate.add_random_edges(old, tree_nodes, retis, count, r)
        heads = [b for _, b in new]
        nodes = {v for a in new for v in a}
        added = nodes - {v for a in old for v in a}
        assert len(set(new)) == len(new) == len(old) + count + tree_nodes + retis
        assert sum(heads.count(v) > 1 for v in added) == retis and len(added) == tree_nodes + retis
        assert len({v for v in nodes if heads.count(v) > 1}) == retis
        assert not any(v in below(new, w) for v, w in new)
    with pytest.raises(ValueError):
        generate.add_random_edges(old, 1, 0, 1, r)
    with pytest.raises(ValueError):
        generate.add_random_edges(old, 3, 1, 2, r)
