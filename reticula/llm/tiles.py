"""Tiles: compare all rows of a group without handing the group to one task.

A group of any size is cut into blocks of home rows (at most about ``block`` rows).
Every other row of the group visits each block as a probe.  A task holds one block
and streams its probes past it, so memory is bounded by the block, and the work of
a large group spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOME, PROBE = 0, 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce the links (a[i], b[i]) to a spanning star of each connected part.

    Returns (node, root) with node <> root: fewer rows than nodes, whatever the
    number of links.
    """
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        np.minimum.at(new, x, new[y])
        np.minimum.at(new, y, new[x])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def lay_tiles(rows: DataFrame, sizes: DataFrame, key: str, node: str, block: int, both_ways: bool) -> DataFrame:
    """Give rows of the groups in ``sizes(key, _n)`` their tiles.

    Adds ``_block`` and ``_kind``.  ``both_ways``: a pair of blocks meets twice
    (each side is home once), else once.
    """
    n_blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    laid = (rows.join(sizes, key).withColumn("_blocks", n_blocks)
            .withColumn("_own", F.expr(f"cast(pmod(xxhash64({node}), _blocks) as int)")))
    last = F.col("_blocks") - 1 if both_ways else F.col("_own")
    return (laid.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("_kind", F.when(F.col("_block") == F.col("_own"), HOME).otherwise(PROBE))
            .drop("_n", "_blocks", "_own"))


def run_tiles(tiles: DataFrame, keys: list[str], kernel: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """Bring each tile together, home rows first, and run ``kernel`` over the streams."""
    spark = tiles.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (tiles.repartition(n, *keys).sortWithinPartitions(*keys, "_kind").mapInArrow(kernel, schema))


def stream_tiles(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Split sorted batches at tile and kind borders: yields (tile number, rows of one tile and kind)."""
    tile, last = -1, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "_kind"]]
        change = np.zeros(n, dtype=bool)
        new_tile = np.zeros(n, dtype=bool)
        for i, c in enumerate(columns):
            differs = c[1:] != c[:-1]
            change[1:] |= differs
            if i < len(keys):
                new_tile[1:] |= differs
        first = tuple(c[0] for c in columns[:-1])
        new_tile[0] = first != last
        change[0] = True
        last = tuple(c[-1] for c in columns[:-1])
        starts = np.flatnonzero(change)
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            tile += bool(new_tile[s])
            yield tile, batch.slice(s, e - s)
