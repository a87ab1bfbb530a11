"""Random networks, by seeded kernels over a range of net ids."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EDGES = "net_id long, src long, dst long"


def numbers(n: int | None = None, r: int | None = None, leaves: int | None = None) -> tuple[int, int, int]:
    """(tree nodes, reticulations, leaves) from any two of nodes, reticulations, leaves; about a tenth reticulations from one."""
    if n is None and r is None and leaves is None:
        n, r = 99, 10
    if n is not None and r is None and leaves is None:
        r = n // 10
        n += 1 - n % 2
    if leaves is None and n is not None:
        leaves = (n - 2 * r + 1) // 2
    elif n is None:
        if r is None:
            r = leaves // 10
        n = 2 * r + 2 * leaves - 1
    elif r is None:
        r = (n - 2 * leaves + 1) // 2
    if n % 2 == 0 or r < 0 or leaves < 1 or n != 2 * r + 2 * leaves - 1:
        raise ValueError("no binary network has these numbers")
    return n - r - leaves, r, leaves


def random_tree(inner: int, leaves: int, rng: random.Random) -> list[tuple[int, int]]:
    """A tree with so many inner nodes, each with two children or more."""
    if inner and leaves < inner + 1:
        raise ValueError("too few leaves")
    arcs: list[tuple[int, int]] = []
    tips, ids = [0], 1
    for _ in range(inner):  # open a tip: it gets two children
        v = tips.pop(rng.randrange(len(tips)))
        arcs += [(v, ids), (v, ids + 1)]
        tips += [ids, ids + 1]
        ids += 2
    inside = sorted({a for a, _ in arcs})
    while len(tips) < leaves:
        v = rng.choice(inside)
        arcs.append((v, ids))
        tips.append(ids)
        ids += 1
    return arcs


def add_random_arcs(arcs: list[tuple[int, int]], count: int, rng: random.Random) -> list[tuple[int, int]]:
    """Subdivide two arcs and join the new nodes, ``count`` times, never closing a cycle."""
    arcs = list(arcs)
    for _ in range(count):
        below: dict[int, list[int]] = {}
        for a, b in arcs:
            below.setdefault(a, []).append(b)
        ids = max(max(a, b) for a, b in arcs) + 1
        while True:
            (a, b), (c, d) = rng.sample(arcs, 2)
            seen, todo = {d}, [d]  # the head d must not reach a
            while todo:
                for x in below.get(todo.pop(), []):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if a not in seen:
                break
        s, t = ids, ids + 1
        arcs.remove((a, b))
        arcs.remove((c, d))
        arcs += [(a, s), (s, b), (c, t), (t, d), (s, t)]
    return arcs


def add_random_edges(arcs: list[tuple[int, int]], tree_nodes: int, reticulations: int, count: int, rng: random.Random) -> list[tuple[int, int]]:
    """``count`` more arcs, whose tails are ``tree_nodes`` new nodes and whose heads ``reticulations`` new ones.

    All other ends are nodes that are there: tails inner tree nodes, heads reticulations.  New
    nodes subdivide random arcs; the result stays acyclic and has no arc twice.  Which arcs get
    the new nodes is drawn; draws that leave no place start again, 100 times before it is
    an error.
    """
    if max(tree_nodes, reticulations) > count:
        raise ValueError("more new nodes than new arcs")
    if count and len(arcs) < 2:
        raise ValueError("a network with one arc takes no more")
    if count and not reticulations and max(Counter(b for _, b in arcs).values()) < 2:
        raise ValueError("arcs added to a tree make a reticulation")
    for _ in range(100):
        found = _grow(list(arcs), tree_nodes, reticulations, count, rng)
        if found is not None:
            return found
    raise ValueError("no place found for the new arcs")


def _grow(arcs: list[tuple[int, int]], tree_nodes: int, reticulations: int, count: int, rng: random.Random) -> list[tuple[int, int]] | None:
    for left in range(count, 0, -1):
        for _ in range(20 + 4 * len(arcs)):
            grown, free = list(arcs), max(v for a in arcs for v in a) + 1
            heads = Counter(b for _, b in grown)
            tails = {a for a, _ in grown}
            ends: list[int] = []
            for new, pool in ((tree_nodes, sorted(v for v in tails if heads[v] < 2)), (reticulations, sorted(v for v in heads if heads[v] > 1))):
                # All that is left must be new, or the draw decides, or there are no old nodes.
                if new and (new == left or not pool or rng.random() < new / left):
                    a, b = grown.pop(rng.randrange(len(grown)))
                    grown += [(a, free), (free, b)]
                    ends.append(free)
                    free += 1
                else:  # the root is an old tail; without an old reticulation a head is new
                    ends.append(rng.choice(pool))
            s, t = ends
            if s != t and (s, t) not in grown and not _reaches(grown, t, s):
                break
        else:
            return None
        tree_nodes -= s not in tails
        reticulations -= t not in heads
        arcs = [*grown, (s, t)]
    return arcs


def _reaches(arcs: list[tuple[int, int]], start: int, goal: int) -> bool:
    below: dict[int, list[int]] = {}
    for a, b in arcs:
        below.setdefault(a, []).append(b)
    seen, todo = {start}, [start]
    while todo:
        for x in below.get(todo.pop(), []):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return goal in seen


def random_binary_network(reticulations: int, leaves: int, rng: random.Random) -> list[tuple[int, int]]:
    """A binary network with exactly these numbers: a random tree and inserted arcs."""
    if leaves < 2:
        if reticulations or leaves < 1:
            raise ValueError("a network with reticulations has two leaves or more")
        return []
    return add_random_arcs(random_tree(leaves - 1, leaves, rng), reticulations, rng)


def networks(spark: SparkSession, count: int, reticulations: int, leaves: int, seed: int = 0) -> DataFrame:
    """``count`` random networks; each depends on its id and the seed alone."""
    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, a, b) for k in frame["id"] for a, b in random_binary_network(reticulations, leaves, random.Random(f"{seed}/{k}"))]
            yield pd.DataFrame(rows, columns=["net_id", "src", "dst"])

    return spark.range(count).mapInPandas(kernel, EDGES)


def networks_with_edges(spark: SparkSession, count: int, inner: int, leaves: int, tree_nodes: int, reticulations: int, arcs: int, seed: int = 0) -> DataFrame:
    """``count`` random trees with ``arcs`` more arcs each, see ``add_random_edges``."""
    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k in frame["id"]:
                rng = random.Random(f"{seed}/{k}")
                rows += [(k, a, b) for a, b in add_random_edges(random_tree(inner, leaves, rng), tree_nodes, reticulations, arcs, rng)]
            yield pd.DataFrame(rows, columns=["net_id", "src", "dst"])

    return spark.range(count).mapInPandas(kernel, EDGES)


def birth_process(leaves: int, rng: random.Random) -> list[tuple[int, int, float]]:
    """A pure-birth tree: exponential waiting times, a uniform lineage splits."""
    born, arcs, tips, ids, now = {0: 0.0}, [], [0], 1, 0.0
    while len(tips) < leaves:
        now += rng.expovariate(len(tips))
        v = tips.pop(rng.randrange(len(tips)))
        arcs.append((v, now - born[v]))
        born[ids] = born[ids + 1] = now
        tips += [ids, ids + 1]
        ids += 2
    length = dict(arcs) | {t: now - born[t] for t in tips}
    parents = [v for v, _ in arcs]
    return [(p, c, length[c]) for k, p in enumerate(parents) for c in (2 * k + 1, 2 * k + 2)]
