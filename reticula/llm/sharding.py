"""Sharding by bytes: global prefix sums of sizes, cut at equal targets. DataFrame functions only.

The documents get a total order (text hash, id, ...), in which equal texts stand together.
Per-partition totals of a range partition give every document the sum of all sizes before
it; the document goes to the shard into whose equal share of the total the middle of the
document falls.  So shards are contiguous in that order and differ by one document at most.
Only digests of the texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_totals

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row, law ``bytes``.

    Returns the id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law``,
    ``shard`` (0 to shards - 1), ``slot`` (gapless from 0 in each shard) and ``grown_shard``
    (null: under this law any shard count is a new cut).

    Cases: null text has no bytes and the checksum of the empty text; rows with equal id and
    text are interchangeable; a null id ranks last among equal texts; fewer rows than shards
    leave shards empty.  Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), byte_size(F.col(text_col)).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    order = [F.col("_hash"), F.col("size"), F.col("text_crc32"), F.col("id").asc_nulls_last()]
    placed = running_totals(rows, order, F.col("size"))
    total = placed.groupBy("_pid").agg(F.sum("size").alias("_s")).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_all"))
    shard = F.least(F.lit(shards - 1), F.expr(f"cast((cast(_before as decimal(38, 0)) + size div 2) * {shards} div greatest(_all, 1) as int)"))
    dealt = cut(placed.crossJoin(F.broadcast(total)).withColumn("shard", shard).drop("_all"))  # one row
    # Slots: rows before it in its shard = rank in partition and shard + rows of the shard in earlier partitions.
    counts = dealt.groupBy("_pid", "shard").agg(F.count("*").alias("_rows"))  # partitions + shards rows
    ahead = Window.partitionBy("shard").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).drop("_rows")
    rank = F.row_number().over(Window.partitionBy("_pid", "shard").orderBy("_before", F.col("id").asc_nulls_last())) - 1
    return (dealt.withColumn("_rank", rank).join(counts, ["_pid", "shard"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rank") + F.col("_ahead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
