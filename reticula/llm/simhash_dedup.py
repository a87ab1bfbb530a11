"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify Hamming distance.

A fingerprint is cut into ``blocks`` pieces.  Two fingerprints that differ in at most
d bits differ in at most d pieces, so they agree on some ``blocks - d`` pieces; each
choice of that many pieces is a key, and pairs that share a key are verified.  Every
number of pieces above d finds every pair; more pieces give longer, more selective
keys and more rows, so the number follows the number of fingerprints (a plan choice
that changes no result).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, pack
from .components import components
from .tiles import HOME, forest, lay_tiles, run_tiles, stream_tiles

SEED, SHINGLE, BITS, DISTANCE = 42, 4, 64, 4
#: Keys with more fingerprints than this are cut into tiles.
BLOCK = 4096


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of UTF-8 text: words of the text in lower case (A-Z only), shingles of ``width`` words."""
    import xxhash

    words = text.lower().split()  # of bytes: exactly A-Z, and space with controls 9 to 13
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65_536):  # bounded memory for texts of any length
        a, b = starts[at: min(n, at + 65_536)].tolist(), last[at: min(n, at + 65_536)].tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[x:y] for x, y in zip(a, b, strict=True)], repeat(SEED)), np.uint64, len(a))
        counts += bit_counts(h)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have bit i set, for i from 0: eight byte lanes at a time."""
    counts = np.zeros(BITS, dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    rows = np.arange(0, len(h), 255)  # a lane holds sums up to 255
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & lanes, rows)
        counts[j::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id``, ``row`` (digest of the text: tells rows of one id apart) and ``fp`` of each row."""
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps, rows = [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or b""
                fps.append(_signed(fingerprint(text, width)))
                rows.append(_signed(xxhash.xxh64_intdigest(text, SEED)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.int64()), pa.array(fps, pa.int64())], names=["id", "row", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(kernel, "id long, row long, fp long")


def pieces(count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` nearly equal pieces."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def key_masks(n: int, distance: int) -> list[int]:
    """Bit masks of the keys for ``n`` fingerprints: fewest pieces whose keys hold few fingerprints each."""
    for blocks in range(distance + 1, 2 * distance + 2):
        parts = pieces(blocks)
        if 2 ** (BITS * (blocks - distance) // blocks) >= 4 * n:
            break
    return [sum(((1 << w) - 1) << s for s, w in chosen) for chosen in combinations(parts, blocks - distance)]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _small_kernel(distance: int):
    """Rows sorted by (_m, _key), no key with many rows: compare rows 1, 2, ... apart while keys agree."""
    def links(m, k, fp):
        out = []
        live = np.arange(len(fp) - 1)
        d = 1
        while len(live):
            live = live[live + d < len(fp)]
            live = live[(k[live] == k[live + d]) & (m[live] == m[live + d])]
            hit = live[_near(fp[live], fp[live + d], distance)]
            if len(hit):
                out.append((fp[hit], fp[hit + d]))
            d += 1
        if not out:
            return None
        return forest(np.concatenate([x for x, _ in out]).view(np.int64), np.concatenate([y for _, y in out]).view(np.int64))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("_m", "_key", "fp")]
            now[2] = now[2].view(np.uint64)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            m, k, fp = now
            border = np.flatnonzero((m != m[-1]) | (k != k[-1])) if len(fp) else []
            full = int(border[-1]) + 1 if len(border) else 0  # the last key may go on
            rest = [x[full:] for x in now]
            if full and (found := links(m[:full], k[:full], fp[:full])):
                yield _out(*found)
        if rest is not None and len(rest[2]) > 1 and (found := links(*rest)):
            yield _out(*found)

    return kernel


def _large_kernel(distance: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home = -1, np.zeros(0, np.uint64)
        for tile, batch in stream_tiles(batches, ["_m", "_key", "_block"]):
            if tile != now:
                now, home = tile, np.zeros(0, np.uint64)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if batch.column("_kind")[0].as_py() == HOME:
                home = np.concatenate([home, fp])  # at most a block
            for at in range(0, len(fp), 512):
                part = fp[at: at + 512]
                i, j = np.nonzero(_near(home[:, None], part[None], distance))
                differ = home[i] != part[j]
                if differ.any():
                    yield _out(*forest(home[i[differ]].view(np.int64), part[j[differ]].view(np.int64)))

    return kernel


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``fps(fp long)``, distinct -> links (a, b): a spanning star of the linked pairs of each task."""
    n = fps.count()
    masks = key_masks(max(n, 1), distance)
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in masks])).alias("_m", "_key"))
    spark = fps.sparkSession
    hot = keys.groupBy("_m", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    hot = cut(hot)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if hot.isEmpty():
        small, large = keys, None
    else:
        # The hot keys are no more than keys / block rows.
        small = keys.join(hot.drop("_n"), ["_m", "_key"], "left_anti")
        large = run_tiles(_hot_tiles(keys, hot, block), ["_m", "_key", "_block"], _large_kernel(distance), "a long, b long")
    found = small.repartition(parts, "_m", "_key").sortWithinPartitions("_m", "_key", "fp").mapInArrow(_small_kernel(distance), "a long, b long")
    return found if large is None else found.union(large)


def _hot_tiles(keys: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    joined = keys.withColumn("_group", F.struct("_m", "_key"))
    sizes = hot.select(F.struct("_m", "_key").alias("_group"), "_n")
    return lay_tiles(joined, sizes, "_group", "fp", block, both_ways=False).drop("_group")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int, block: int) -> DataFrame:
    """id, row, fp, component (a fingerprint), component_id of every row."""
    rows = cut(pack(fingerprints(docs, id_col, text_col, width), shuffled=False))
    classes = cut(pack(rows.groupBy("fp").agg(F.min("id").alias("least"))))
    parts = components(link_fingerprints(classes.select("fp"), distance, block))
    named = cut(pack(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "least", F.coalesce("component", "fp").alias("component"))))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Fingerprint and component of every row, by links of at most ``distance`` differing bits.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id
    reachable, its own included).

    Cases: null text counts as empty; texts without words have fingerprint zero and link
    like any other; fewer words than ``width`` form one shingle; repeated rows share a
    component.  A null id ranks after all others; a component without ids has a null
    component_id.  Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, width, distance, block).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
          distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Keep one document of each component, the one with the smallest id; columns as given.

    Of rows with one id the one with the smaller text digest stays, of equal rows any
    one; a null id ranks last.
    """
    found = cut(pack(_grouped(docs, id_col, text_col, width, distance, block).withColumnRenamed("row", "key")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    stay = found.groupBy("component").agg(first).select("first.id", "first.key")
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return keep_rows(docs, id_col, key, found, stay)
