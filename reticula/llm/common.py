"""What the operators of this package share: prefix sums, choice of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, pack

#: White space of the contracts: space and the controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: A key is hot from so many rows on, and there are never more hot keys than this.
HOT_ROWS, HOT_KEYS = 512, 100_000


def running_totals(df: DataFrame, order: list[Column], value: Column, within: str | None = None) -> DataFrame:
    """Add ``_before``: the total of ``value`` over all earlier rows of the global order.

    Rows are range-partitioned by (``within``, ``order``), so that one value of
    ``within`` that holds most rows spreads over many partitions.  Each partition
    yields its totals (a row per partition and value of ``within``); prefix sums
    over those small totals are added to prefix sums inside the partitions.
    ``order`` must be a total order for a deterministic result.  Adds ``_pid`` too.
    """
    spark = df.sparkSession
    keys = ([F.col(within).asc_nulls_last()] if within else []) + order
    ranged = df.withColumn("_v", value.cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    ranged = cut(pack(ranged))
    group = ["_pid"] + ([within] if within else [])
    totals = ranged.groupBy(*group).agg(F.sum("_v").alias("_total"))
    # One row for each partition (and value of ``within`` in it): bounded by the
    # partition count, not by the data.
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if within:
        ahead = Window.partitionBy(within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    inner = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_inner", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    on = rows["_pid"] == totals["_pid"]
    if within:
        on = on & rows[within].eqNullSafe(totals[within])
    # No forced broadcast: the planner broadcasts the totals if they are small.
    joined = rows.join(totals, on, "left").select(
        *[rows[c] for c in ranged.columns], (rows["_inner"] + totals["_offset"]).alias("_before"))
    return joined.drop("_v")


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which has a row for each key and in ``count`` how many of ``rows`` have that key.

    Rows of hot keys stay where they are and meet a broadcast of those keys: a key is hot if its
    rows are more than HOT_ROWS and than 1/HOT_KEYS of all, so no more than HOT_KEYS keys are.
    All others meet by the usual join, whose keys are small.  ``table`` should be cut.
    """
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = table.where(F.col(count) > max(HOT_ROWS, total // HOT_KEYS + 1))
    if total <= HOT_ROWS or hot.isEmpty():
        return rows.join(table, keys, how)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(table, keys, how)
    return marked.where("_hot").select(*rest.columns).union(rest)


def keep_rows(docs: DataFrame, id_col: str, key: Column, rows: DataFrame, stay: DataFrame) -> DataFrame:
    """Of ``docs`` the rows that ``stay(id, key)`` names, one for each name; columns as given.

    ``rows(id, key)`` has the names of all rows.  Rows that share id and key are equal for
    our purpose; only where a name occurs twice is the sort that picks one of them planned.
    """
    stay = cut(pack(stay.select(F.col("id").alias("_stay_id"), F.col("key").alias("_stay_key"))))
    keyed = docs.withColumn("_row_key", key)
    match = keyed[id_col].cast("long").eqNullSafe(stay["_stay_id"]) & (keyed["_row_key"] == stay["_stay_key"])
    kept = keyed.join(stay, match, "left_semi")
    if not rows.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "_row_key"])
    return kept.select(*docs.columns)
