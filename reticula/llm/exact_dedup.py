"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text is cut into blocks of fixed size.  Sorting the distinct blocks gives each an
integer name; equal blocks, equal names.  Then pairs of adjacent names are named the
same way, level by level, until one name is left.  (levels, name) is the identity of
the text: two documents share it exactly if their texts are equal, since every step
maps equal to equal and different to different.

Only the first level touches text: one shuffle of the blocks, grouped by hash and
content (equal blocks meet before the shuffle, on the map side).  Occurrences get
their names back through the 64-bit hash alone wherever one content has that hash;
contents that share a hash are told apart by comparing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, join_counted, keep_rows, pack

#: Characters of a block.
BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " ")


def _blocks(text: Column, size: int) -> Column:
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names for distinct rows: their ranks in the sort of each partition, with the partition's number above."""
    return cut(pack(distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())))


def identities(docs: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64,
               keep: list[str] | None = None) -> DataFrame:
    """``docs`` columns ``keep`` with ``uid`` (row number), ``text_sha256``, ``level`` and ``name`` (the identity).

    ``hash_bits`` under 64 weakens the block hash (for tests of hash collisions).
    """
    mask = (1 << hash_bits) - 1 if hash_bits < 64 else -1
    hashed = lambda x: F.xxhash64(x).bitwiseAND(F.lit(mask))
    text = normalised(F.col(text_col))
    rows = docs.select(*[F.col(c) for c in keep or []], text.alias("_text"))
    rows = rows.select(*(keep or []), F.sha2("_text", 256).alias("text_sha256"), F.transform(_blocks(F.col("_text"), block_chars), hashed).alias("_hashes"))
    rows = cut(pack(rows.withColumn("uid", F.monotonically_increasing_id()), shuffled=False))
    spots = rows.select("uid", F.size("_hashes").alias("_n"), F.posexplode("_hashes").alias("_i", "_h"))

    # Level 0: name the blocks.
    blocks = docs.select(F.explode(_blocks(normalised(F.col(text_col)), block_chars)).alias("_block")).select(hashed(F.col("_block")).alias("_h"), "_block")
    distinct = blocks.groupBy("_h", "_block").agg(F.count("*").alias("_many"))
    names = cut(pack(distinct.sortWithinPartitions("_h", "_block").select("_h", F.monotonically_increasing_id().alias("name"), F.sha2("_block", 256).alias("_sha"), "_many")))
    shared = cut(pack(names.groupBy("_h").agg(F.count("*").alias("_contents"), F.min("name").alias("name"), F.sum("_many").alias("_many"))))
    symbols = join_counted(spots, shared, ["_h"], "_many", "left")
    if not shared.where("_contents > 1").isEmpty():
        symbols = _told_apart(docs, text_col, block_chars, hashed, rows, shared, symbols, keep)
    symbols = cut(pack(symbols.select("uid", "_n", "_i", "name")))

    # Further levels: name pairs of adjacent names; a document leaves when one is left.
    done, level = [], 0
    while True:
        done.append(symbols.where("_n = 1").select("uid", F.lit(level).alias("level"), "name"))
        symbols = symbols.where("_n > 1")
        if symbols.isEmpty():
            break
        level += 1
        even = F.col("_i") % 2 == 0
        pairs = (symbols.groupBy("uid", "_n", F.floor(F.col("_i") / 2).cast("int").alias("_i"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("_a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("_b")))
        pairs = cut(pack(pairs))
        names = _named(pairs.groupBy("_a", "_b").agg(F.count("*").alias("_many")), "_a", "_b")
        symbols = join_counted(pairs, names, ["_a", "_b"], "_many").select("uid", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), "_i", "name")
        symbols = cut(pack(symbols))
    found = done[0]
    for x in done[1:]:
        found = found.union(x)
    return rows.drop("_hashes").join(found, "uid")


def _told_apart(docs, text_col, block_chars, hashed, rows, shared, symbols, keep):
    """Names of the blocks whose hash belongs to several contents: by the contents themselves.

    The distinct contents under those hashes get names of their own, and the documents'
    blocks are matched with them byte by byte.  The row numbers come from the text digest
    and position, since two evaluations of ``docs`` need not agree on row numbers.
    """
    clash = shared.where("_contents > 1").select("_h")
    text = docs.select(normalised(F.col(text_col)).alias("_text"))
    spots = (text.select(F.sha2("_text", 256).alias("text_sha256"), F.posexplode(_blocks(F.col("_text"), block_chars)).alias("_i", "_block"))
             .withColumn("_h", hashed(F.col("_block"))).join(clash, "_h", "left_semi"))
    spots = cut(spots.groupBy("text_sha256", "_i", "_h", "_block").agg(F.lit(1).alias("_one")).drop("_one"))
    names = _named(spots.select("_h", "_block").distinct(), "_h", "_block")
    # Names below zero: apart from those of the other blocks, and from -1.
    exact = spots.join(names, ["_h", "_block"]).select("text_sha256", "_i", (-2 - F.col("name")).alias("_exact"))
    keyed = symbols.join(rows.select("uid", "text_sha256"), "uid")
    return keyed.join(exact, ["text_sha256", "_i"], "left").withColumn("name", F.coalesce("_exact", "name"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
                     hash_bits: int = 64) -> DataFrame:
    """Groups of equal texts (equal after white space runs become one space).

    Returns a row per row: the id, ``keep_id`` (smallest id of the group), ``group_size``
    long, ``kept`` and ``text_sha256`` (of the normalised text).

    Cases: null text counts as empty; a null id ranks after all others; of repeated rows
    with the smallest id one is kept; a text of any length is cut into blocks; an empty table
    gives no rows.  Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(pack(identities(source, "text", block_chars, hash_bits, ["id"])))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    groups = cut(pack(found.groupBy("level", "name").agg(F.min(rank).alias("_first"), F.count("*").alias("group_size"))))
    return join_counted(found, groups, ["level", "name"], "group_size").select(
        F.col("id").alias(id_col), F.col("_first.id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("_first.uid")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep of equal texts the row with the smallest id; columns as given, text unchanged.

    Cases: as in ``exact_duplicates``; null and empty texts are equal, so one of them stays.
    """
    groups = cut(pack(exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), "kept")))
    return keep_rows(docs, id_col, F.sha2(normalised(F.col(text_col)), 256), groups, groups.where("kept"))
