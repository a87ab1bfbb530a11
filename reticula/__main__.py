"""Command line: ``python -m reticula iso|tc|scanwidth|gen|branch-len|node-data ...`` for single network files.

Collections of networks go through the DataFrame operators; these commands call the same
kernels on one network or pair.
"""

from __future__ import annotations

import argparse
import random
import sys

from .operators import containment, iso, scanwidth
from .sources import generate
from .sources.newick import ascii_tree, format_network, parse_any


def _load(*paths: str) -> list[tuple[list[tuple[int, int, float | None]], dict[int, str]]]:
    """Networks of the files: one per line of Newick, or one edge list per file."""
    out = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        lines = [x for x in text.splitlines() if x.strip()]
        out += [parse_any(x) for x in lines] if ";" in text else [parse_any(text)]
    return out


def _arcs(net) -> list[tuple[int, int]]:
    return [x[:2] for x in net[0]]


def _labels(net, flags: str) -> dict[int, str]:
    heads, tails = [b for _, b, _ in net[0]], {a for a, _, _ in net[0]}
    kind = lambda v: "r" if heads.count(v) > 1 else "t" if v in tails else "l"
    return {v: s for v, s in net[1].items() if kind(v) in flags}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="reticula")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("iso", help="are two networks isomorphic?")
    c.add_argument("files", nargs="+")
    c.add_argument("-l", "--labels", default="ltr", help="whose labels count: l leaves, t tree nodes, r reticulations")
    c = sub.add_parser("tc", help="does a network display a tree?")
    c.add_argument("files", nargs="*")
    c.add_argument("-r", "--random", nargs=3, type=int, metavar=("INNER", "LEAVES", "ARCS"))
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("scanwidth", help="minimum scanwidth and extension")
    c.add_argument("file")
    c.add_argument("-m", "--minimum", action="store_true", help="print the scanwidth")
    c.add_argument("-e", "--extension", action="store_true", help="print the extension")
    c.add_argument("-et", "--tree", action="store_true", help="print the extension tree with its widths")
    c.add_argument("-pp", "--postorder", action="store_true", help="take a post-order instead of the best extension")
    c = sub.add_parser("gen", help="random binary network")
    c.add_argument("-n", type=int)
    c.add_argument("-r", type=int)
    c.add_argument("-l", type=int)
    c.add_argument("-s", "--seed", type=int, default=0)
    c.add_argument("-a", "--append", action="store_true")
    c.add_argument("file", nargs="?")
    for name in ("branch-len", "node-data"):
        sub.add_parser(name).add_argument("file")
    o = p.parse_args(argv)

    if o.command == "iso":
        a, b = _load(*o.files)[:2]
        same = iso.isomorphic_kernel(_arcs(a), _labels(a, o.labels), _arcs(b), _labels(b, o.labels))
        print("isomorphic" if same else "not isomorphic")
        return int(not same)
    if o.command == "tc":
        if o.random:
            rng = random.Random(o.seed)
            tree = generate.random_tree(o.random[0], o.random[1], rng)
            names = {v: f"t{v}" for v in {b for _, b in tree} - {a for a, _ in tree}}
            host, guest = (generate.add_random_arcs(tree, o.random[2], rng), names), (tree, names)
        else:
            nets = [(_arcs(x), x[1]) for x in _load(*o.files)[:2]]
            is_tree = [len({b for _, b in a}) == len(a) for a, _ in nets]
            if not any(is_tree):
                print("network in network is not offered", file=sys.stderr)
                return 2
            host, guest = nets if is_tree[1] else nets[::-1]
        if o.verbose:
            for arcs, names in (host, guest):
                print(ascii_tree(arcs, names, 0))
        shown = containment.network_displays(*host, *guest)
        print("displayed" if shown else "not displayed")
        return int(not shown)
    if o.command == "scanwidth":
        net = _load(o.file)[0]
        arcs = _arcs(net)
        if o.postorder:
            order = scanwidth.any_extension(arcs)
        else:
            order = scanwidth.min_extension(arcs)[1]
        rows = scanwidth.tree_and_widths(arcs, order)
        if o.minimum or not (o.extension or o.tree):
            print(f"scanwidth {max((w for *_, w in rows), default=0)}")
        if o.extension:
            print("extension", *(net[1].get(v, v) for v in order))
        if o.tree:
            for node, parent, width in rows:
                print(node, net[1].get(node, ""), parent if parent is not None else "-", width)
        return 0
    if o.command == "gen":
        _, retis, leaves = generate.numbers(o.n, o.r, o.l)
        arcs = generate.random_binary_network(retis, leaves, random.Random(o.seed))
        names = {v: f"t{v}" for v in {b for _, b in arcs} - {a for a, _ in arcs}}
        text = format_network(arcs, names, 0)
        if o.file:
            with open(o.file, "a" if o.append else "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
        return 0
    arcs, names = _load(o.file)[0]
    if o.command == "branch-len":
        for a, b, x in arcs:
            print(names.get(a, a), names.get(b, b), x or 0.0)
    else:
        for v, s in sorted(names.items()):
            print(v, s, s.count("N"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
