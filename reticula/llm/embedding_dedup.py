"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Method.  Equal vectors form classes.  Class vectors are scaled to length 1 and
quantised to int8 with one scale each; the length of the quantisation error is kept.
For unit vectors x = s_x q_x + e_x and y = s_y q_y + e_y

    x.y <= s_x s_y (q_x.q_y) + |e_x| |s_y q_y| + |s_x q_x| |e_y| + |e_x| |e_y|

so a pair whose right side is under the threshold cannot be a link.  Tiles of
integer products (exact in float32 while dim * 127^2 < 2^24) find the pairs that may
be; only those are recomputed in double precision.

Scale.  Beyond ``cell_rows`` classes the vectors are dealt to the cells of centroids
fitted on a bounded, deterministic sample.  A vector visits another cell only if it is
within the link distance of the plane between both centroids and of the ball that holds
that cell: no link can cross what is farther away, so nothing is lost.  Of two cells only
one's vectors visit the other's, and blocks of a cell meet once, so each pair is looked at
once.  Cells are cut into tiles, whose blocks grow with the data up to a bound in bytes.
Vectors travel in the type they came in.  A tile emits link counts and a spanning star of
its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..plans.lineage import drop
from .common import HOT_KEYS, cut
from .components import components
from .tiles import HOME, PROBE, forest, run_tiles, stream_tiles

CELL_ROWS = 8192
#: Bounds of the centroid fit on the driver: bytes of the centroids, sampled vectors for each.
CENTROID_BYTES, SAMPLE_PER_CELL = 4_000_000, 8
#: A block's rows: so many at least, 1/64 of all if that is more, within so many bytes.
BLOCK, BLOCK_BYTES = 4096, 16_000_000


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32), scale, error length, length of the scaled code."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None])
    near = code * scale[:, None]
    # 1e-12 covers the rounding of these sums themselves.
    error = np.sqrt(((unit - near) ** 2).sum(axis=1)) + 1e-12
    return code.astype(np.float32), scale, error, np.sqrt((near * near).sum(axis=1)) + 1e-12


def candidates(home: tuple, probe: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (home row, probe row) that the int8 bound cannot exclude."""
    q, s, e, m = home
    p, t, f, k = probe
    exact = q.shape[1] * 127 * 127 < 2**24
    product = (q @ p.T) if exact else (q.astype(np.float64) @ p.T.astype(np.float64))
    # The part of the bound that is not the product, as one outer sum of rank two.
    slack = np.outer(e, k + f) + np.outer(m, f)
    return np.nonzero(product * np.outer(s, t) + slack >= threshold - 1e-9)


def exact_links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose double-precision cosine reaches the threshold."""
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 65_536):
        part = slice(at, at + 65_536)
        keep[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    return i[keep], j[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _tile_kernel(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def emit(node, links, other):
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], schema=schema)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, unit, coded, links, pending = -1, None, None, None, None, None, []

        def meet(p_ids, p_sizes, p_unit, p_coded, own=False):
            for at in range(0, len(p_ids), 2048):
                part = slice(at, at + 2048)
                i, j = candidates(coded, tuple(x[part] for x in p_coded), threshold)
                other = p_ids[part]
                differs = ids[i] != other[j]
                i, j = exact_links(unit, p_unit[part], i[differs], j[differs], threshold)
                if len(i):
                    np.add.at(links, i, p_sizes[part][j])
                    a, b = forest(ids[i], other[j])
                    yield emit(a, [None] * len(a), b)
                    if not own:  # the visitors' side of the links
                        far = np.bincount(j, weights=sizes[i], minlength=len(other)).astype(np.int64)
                        some = np.flatnonzero(far)
                        yield emit(other[some], far[some], [None] * len(some))

        def close():
            some = links > 0
            return emit(ids[some], links[some], [None] * int(some.sum()))

        def settle():
            """The home rows are complete: join their parts and compare them with one another."""
            nonlocal ids, sizes, unit, coded, links, pending
            ids, sizes, unit = (np.concatenate(x) for x in zip(*pending, strict=True))
            coded, links, pending = quantise(unit), np.zeros(len(ids), dtype=np.int64), []
            yield from meet(ids, sizes, unit, coded, own=True)

        for tile, batch in stream_tiles(batches, ["_dim", "_cell", "_block"]):
            if tile != now:
                if pending:
                    yield from settle()
                if links is not None:
                    yield close()
                now, links = tile, None
            part = (batch.column("node").to_numpy(), batch.column("size").to_numpy(), _unit(_matrix(batch.column("vector"))))
            if batch.column("_kind")[0].as_py() == HOME:
                pending.append(part)
                continue
            if pending:
                yield from settle()
            if links is not None:  # a block can be without home rows
                yield from meet(*part, quantise(part[2]))
        if pending:
            yield from settle()
        if links is not None:
            yield close()

    return kernel


def _centroids(classes: DataFrame, n: int, cell_rows: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from a bounded sample in hash order."""
    longest = classes.agg(F.max("_dim").alias("d")).first()["d"] or 1
    cells = min(CENTROID_BYTES // (8 * longest) + 1, math.ceil(n / cell_rows))
    if cells < 2:
        return {}
    sample = classes.orderBy(F.xxhash64("vector"), "node").limit(cells * SAMPLE_PER_CELL).select("vector", "_dim").toArrow()
    dims, out = sample.column("_dim").to_numpy(), {}
    for dim in np.unique(dims):
        x = _unit(_matrix(sample.filter(pa.array(dims == dim)).column("vector").combine_chunks()))
        centre = x[: min(cells, len(x))].copy()
        for _ in range(5):
            home = (x @ centre.T - (centre * centre).sum(axis=1) / 2).argmax(axis=1)
            for c in range(len(centre)):
                if (home == c).any():
                    centre[c] = x[home == c].mean(axis=0)
        out[int(dim)] = np.unique(centre, axis=0)
    return out


def _cell_kernel(centroids: dict[int, np.ndarray], reach: float):
    """Home cell of each vector, its distance from the centroid, and the cells it may have to visit with the distance from theirs."""
    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        centre = centroids.get(x.shape[1])
        if centre is None or len(centre) < 2:
            empty = pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.float64())], names=["cell", "away"])
            return np.zeros(len(x), dtype=np.int32), np.zeros(len(x)), pa.ListArray.from_arrays(pa.array(np.zeros(len(x) + 1, np.int32)), empty)
        u = _unit(x)
        square = np.maximum((u * u).sum(axis=1)[:, None] - 2 * u @ centre.T + (centre * centre).sum(axis=1)[None], 0)
        home = square.argmin(axis=1)
        apart = np.sqrt(((centre[home] ** 2).sum(axis=1)[:, None] - 2 * centre[home] @ centre.T + (centre * centre).sum(axis=1)[None]).clip(0))
        gap = square - square[np.arange(len(u)), home][:, None]
        visits = gap <= 2 * (reach + 1e-6) * (apart + 1e-6)
        # Of two cells one visits the other: by parity, so that every cell visits about as many as visit it.
        other = np.arange(len(centre))[None]
        visits &= ((other + home[:, None]) % 2 == 1) == (home[:, None] < other)
        visits[np.arange(len(u)), home] = False
        row, cell = np.nonzero(visits)
        pairs = pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.sqrt(square[row, cell]))], names=["cell", "away"])
        return home.astype(np.int32), np.sqrt(square[np.arange(len(u)), home]), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(u) + 1)).astype(np.int32)), pairs)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                step = max(1, 2_000_000 // max(1, len(centroids.get(int(dim), ()))))
                for at in range(0, rows.num_rows, step):
                    part = rows.slice(at, step)
                    home, out, visits = cells(_matrix(part.column("vector")))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("node", "size", "vector", "_dim")), pa.array(home, pa.int32()), pa.array(out), visits],
                        names=["node", "size", "vector", "_dim", "_home", "_out", "_visits"])

    return kernel


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    cell_rows: int = CELL_ROWS, block: int | None = None) -> DataFrame:
    """Links of cosine >= ``threshold`` (double precision) between all rows.

    Returns a row per input row: the id column, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, its own included) and ``kept``
    (id = component_id).

    Cases: a vector that is null, empty, zero or holds a null or non-finite component
    links with nothing and is its own component.  Vectors of different lengths don't
    link.  Repeated rows link with one another; they share an id and so ``kept``.  A
    null id stays null, ranks after every other id, and is kept only in a component
    without any id.  Vectors of any length are whole; an empty table gives no rows.  Other
    columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    v = F.col("vector")
    given = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    grouped = rows.where(good).groupBy("vector").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), "size", "least", "vector", F.size("vector").alias("_dim")))
    n = classes.count()
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    laid = classes.drop("least").mapInArrow(
        _cell_kernel(_centroids(classes, n, cell_rows), reach),
        f"node long, size long, vector array<{kind}>, _dim int, _home int, _out double, _visits array<struct<cell: int, away: double>>")
    laid = cut(laid)
    # A row for each centroid: its blocks, and the ball that holds its vectors.
    block_rows = F.lit(block) if block else F.greatest(F.lit(1), F.least(F.lit(max(BLOCK, n // 64)), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("_dim")))))
    sizes = laid.groupBy("_dim", F.col("_home").alias("_cell")).agg(F.count("*").alias("_n"), F.max("_out").alias("_radius"))
    sizes = cut(sizes.select("_dim", "_cell", F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"), "_radius"))
    sizes = F.broadcast(sizes) if sizes.count() <= HOT_KEYS else sizes  # rows of four numbers
    own = F.expr("cast(pmod(xxhash64(node), _blocks) as int)")
    there = laid.withColumnRenamed("_home", "_cell").join(sizes, ["_dim", "_cell"]).withColumn("_own", own)
    home = there.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_own")))).withColumn("_kind", F.when(F.col("_block") == F.col("_own"), HOME).otherwise(PROBE))
    # Visitors that pass the ball test.
    away = laid.select("_dim", "node", "size", "vector", F.explode("_visits").alias("_v")).select("_dim", F.col("_v.cell").alias("_cell"), "_v.away", "node", "size", "vector")
    away = away.join(sizes, ["_dim", "_cell"]).where(F.col("away") <= F.col("_radius") + reach + 1e-6)
    away = away.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_kind", F.lit(PROBE))
    columns = ["_dim", "_cell", "_block", "_kind", "node", "size", "vector"]
    tiles = home.select(*columns).union(away.select(*columns))
    found = cut(run_tiles(tiles, ["_dim", "_cell", "_block"], _tile_kernel(threshold), "node long, links long, other long"))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    drop(laid)
    parts = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = (classes.join(links, "node", "left").join(parts, "node", "left")
             .select("node", "vector", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    facts = named.join(least, "component").select("vector", (F.col("links") + F.col("size") - 1).alias("n_links"), F.col("first").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    linked = rows.where(good).join(facts, "vector").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
