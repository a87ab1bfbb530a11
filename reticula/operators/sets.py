"""Set algebra over (set_id, item) tables, and over array columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairwise(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): sizes of intersection, union, differences, symmetric difference; disjoint, equal.

    The intersection comes from one join on items; everything else follows from sizes, so no
    union is ever built.
    """
    size = sets.groupBy("set_id").agg(F.count("*").alias("n"))
    left = pairs.join(sets.select(F.col("set_id").alias("a"), "item"), "a")
    common = left.join(sets.select(F.col("set_id").alias("b"), "item"), ["b", "item"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("k"))
    n = lambda c: size.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"))
    all_ = pairs.join(n("a"), "a").join(n("b"), "b").join(common, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return all_.select("a", "b", F.col("k").alias("n_intersect"), (F.col("n_a") + F.col("n_b") - F.col("k")).alias("n_union"),
                       (F.col("n_a") - F.col("k")).alias("n_except"), (F.col("n_a") + F.col("n_b") - 2 * F.col("k")).alias("n_symdiff"),
                       (F.col("k") == 0).alias("disjoint"), ((F.col("k") == F.col("n_a")) & (F.col("k") == F.col("n_b"))).alias("same"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def complement(sets: DataFrame, domain: DataFrame, ids: DataFrame) -> DataFrame:
    """(set_id, n_missing): how many items of the domain each set lacks, from counts alone."""
    total = domain.agg(F.count("*").alias("t"))
    inside = sets.join(domain, "item", "left_semi").groupBy("set_id").agg(F.count("*").alias("n"))
    return ids.join(inside, "set_id", "left").join(F.broadcast(total)).select("set_id", (F.col("t") - F.coalesce("n", F.lit(0))).alias("n_missing"))


def set_hash(items: Column) -> Column:
    """Order-insensitive digest of a group."""
    return F.bit_xor(F.xxhash64(items))


def list_hash(items: Column) -> Column:
    """Order-sensitive digest of an array."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseXOR(F.shiftrightunsigned(acc, 63)).bitwiseXOR(F.xxhash64(x)))


def subsets(items: list[int]) -> Iterator[list[int]]:
    """All subsets by binary counting."""
    for mask in range(1 << len(items)):
        yield [x for k, x in enumerate(items) if mask >> k & 1]


def down_sets(children: dict[int, list[int]]) -> Iterator[int]:
    """Bit masks of the sets closed under children, each after all of its down-subsets."""
    order = list(children)
    bit = {x: 1 << k for k, x in enumerate(order)}
    need = {bit[x]: sum(bit[c] for c in set(children[x])) for x in order}
    layer = {0}
    while layer:
        yield from sorted(layer)
        layer = {s | b for s in layer for b, below in need.items() if not s & b and below & s == below}


def kth_member(sets: DataFrame, k: int) -> DataFrame:
    """(set_id, item): the k-th smallest (from 0) item of every set that has so many."""
    n = F.row_number().over(Window.partitionBy("set_id").orderBy("item"))
    return sets.withColumn("_n", n).where(F.col("_n") == k + 1).select("set_id", "item")


def of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, item, in_a, in_b): the members of both sets of each pair."""
    side = lambda c: pairs.join(sets.select(F.col("set_id").alias(c), "item"), c).select("a", "b", "item", F.lit(c == "a").alias("in_a"), F.lit(c == "b").alias("in_b"))
    return side("a").union(side("b")).groupBy("a", "b", "item").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def merge_sorted(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The rows of all tables in one order, by ranges of the order: no table is gathered."""
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.repartitionByRange(*order).sortWithinPartitions(*order)
