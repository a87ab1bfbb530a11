"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Every source gets a share of the demand by its weight, limited to a multiple of its own
size.  Documents of a source stand in hash order; a running total of sizes (range
partitions, prefix sums of partition totals) decides which of them are taken, once or more.
What the last document that fits leaves open is filled by passes over ever smaller ones,
then by the documents no larger than the gap, until none fits.
The source's weight schedule over training time t in [0, 1] is the density
g(t) = 1 + tilt * (2t - 1); its integral G(t) = (1 - tilt) t + tilt t^2 says how much of the
source's words is due by time t.  A document whose words reach the fraction x of the source's
demand gets the training position G^-1(x), and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, cut, pack, running_totals

WEIGHTS, DEMAND, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0
#: Slopes of the weight schedules, by rank of the source: later, even, earlier.
TILTS = (0.5, 0.0, -0.5)
#: First passes that fill what is left of a target, with documents of a quarter of the gap at most.
FILLS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, demand: float = DEMAND, repeats: float = REPEATS) -> DataFrame:
    """``sources(source, source_size)`` -> also ``rank``, ``weight``, ``target``.

    Shares of demand * all sizes by weight; a source over repeats * its size is held there
    and the excess goes to the others by weight, until none is above (water filling).  In
    the order of limit per weight the sources held are a prefix, so window sums find the
    level in one pass.  The table has a row for each source.
    """
    over_all = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(over_all.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked.withColumn("weight", weight).withColumn("_limit", F.lit(repeats) * F.col("source_size"))
    table = table.withColumn("_demand", F.lit(demand) * F.sum("source_size").over(over_all))
    by_level = over_all.orderBy(F.col("_limit") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("_demand") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    table = table.withColumn("_level", rest / F.sum("weight").over(after))
    # The level holds for a source that stays under its limit; the first such fixes it for all later ones.
    free = F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.col("_level"))
    table = table.withColumn("_final", F.first(free, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.coalesce(F.least(F.col("_limit"), F.col("_final") * F.col("weight")), F.col("_limit"))
    return table.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def position(x: Column, tilt: Column) -> Column:
    """G^-1(x): the training time by which the fraction x of a source is due."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x)
    # The form without cancellation, also right for a tilt of 0.
    return 2 * x / ((1 - tilt) + root)


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, demand: float = DEMAND, repeats: float = REPEATS,
         tilts: tuple[float, ...] = TILTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every row.

    Returns the id, ``size`` (words), ``source_size``, ``target``, ``taken`` (words),
    ``copies``, ``position`` of the first copy and ``last_position`` of the last one (null if
    none), ``source`` and ``row`` (digest of the text), range-sorted by position.

    Cases: null text has no words; null sources are one source, ranked last; a row without
    words is taken like others but adds nothing; repeated rows are rows of their own.  With
    no words at all every target is 0; an empty table gives no rows.  A text longer than what its
    source may take is left out or taken whole times.  Other columns are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                       words(text).alias("size"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("row"))
    rows = cut(pack(rows.withColumn("uid", F.monotonically_increasing_id()), shuffled=False))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, demand, repeats))
    order = [F.xxhash64("id", "row"), F.col("id").asc_nulls_last(), F.col("row")]
    placed = running_totals(rows, order, F.col("size"), within="source")
    placed = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.select("p.*", "source_size", "rank", "target", F.floor(share).cast("long").alias("rounds"))
    placed = cut(pack(placed.withColumn("gap", F.col("target") - F.col("rounds") * F.col("source_size"))))
    fits = (F.col("size") > 0) & (F.col("_before") + F.col("size") <= F.col("gap"))
    again = cut(placed.where(fits).select("source", "uid", "size"))
    step = 0
    while True:
        # A row for each source: what is still open.
        open_ = (sources.alias("s").join(again.groupBy("source").agg(F.sum("size").alias("got")).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left")
                 .select(F.col("s.source").alias("_source"), (F.col("target") - F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).otherwise(0) - F.coalesce("got", F.lit(0))).alias("open")))
        free = (placed.select("source", "id", "row", "uid", "size").join(again.select("uid"), "uid", "left_anti").join(open_, F.col("source").eqNullSafe(F.col("_source")))
                .where((F.col("size") > 0) & (F.col("size") <= F.col("open") / (4 if step < FILLS else 1))))
        step += 1
        if step > FILLS:
            # The first in order of those that fit is taken, so each pass takes some while any fits.
            free = cut(pack(free))
            if free.isEmpty():
                break
        more = running_totals(free.select("source", "id", "row", "uid", "size", "open"), order, F.col("size"), within="source")
        again = cut(pack(again.union(more.where(F.col("_before") + F.col("size") <= F.col("open")).select("source", "uid", "size"))))
    placed = placed.join(again.select("uid", F.lit(1).alias("again")), "uid", "left").withColumn("copies", (F.col("rounds") + F.coalesce("again", F.lit(0))).cast("long"))
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), (F.col("rank") % len(tilts) + 1).cast("int"))
    # Copy k starts when k whole passes over the source and the words before it are due.
    due = lambda k: F.least(F.lit(1.0), F.coalesce((k * F.col("source_size") + F.col("_before")) / F.col("target"), F.lit(0.0)))
    some = F.col("copies") > 0
    first = F.when(some, position(due(F.lit(0)), tilt))
    last = F.when(some, position(due(F.col("copies") - 1), tilt))
    return (placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                          "copies", first.alias("position"), last.alias("last_position"), "source", "row")
            .repartitionByRange(F.col("position").asc_nulls_last(), F.col(id_col)).sortWithinPartitions(F.col("position").asc_nulls_last(), id_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: rows taken, repeated as often as taken, in training order; columns as given.

    Cases: null texts and texts without words are taken as often as their source's whole passes;
    rows equal in id, text and source are interchangeable: one stands for each that is taken;
    null ids and sources match null ones; an empty table gives no rows.
    """
    planned = cut(pack(plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)))
    repeated = not planned.groupBy(id_col, "row", "source").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    taken = planned.where("copies > 0")
    # Rows equal in id, text and source are interchangeable: the n-th of them joins the n-th.
    number = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    chosen = taken.select(F.col(id_col).alias("_mix_id"), F.col("row").alias("_mix_row"), F.col("source").alias("_mix_source"), "copies", "position", "last_position")
    chosen = cut(pack(chosen.withColumn("_mix_n", number(["_mix_id", "_mix_row", "_mix_source"]))))
    keyed = docs.withColumn("_row_key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("_row_source", F.col(source_col).cast("string"))
    match = keyed[id_col].cast("long").eqNullSafe(chosen["_mix_id"]) & (keyed["_row_key"] == chosen["_mix_row"]) & keyed["_row_source"].eqNullSafe(chosen["_mix_source"])
    if repeated:  # only equal rows need numbers
        keyed = keyed.withColumn("_row_n", number([F.col(id_col), F.col("_row_key"), F.col("_row_source")]))
        match = match & (keyed["_row_n"] == chosen["_mix_n"])
    joined = keyed.join(chosen, match)
    copy = F.explode(F.sequence(F.lit(1), chosen["copies"].cast("int")))
    out = joined.select(*[keyed[c] for c in docs.columns], chosen["position"].alias("_p0"), chosen["last_position"].alias("_p1"), copy.alias("_copy"))
    at = F.when(F.col("_copy") == 1, F.col("_p0")).otherwise(F.col("_p1"))
    return out.withColumn("_at", at).repartitionByRange("_at", F.col(id_col)).sortWithinPartitions("_at", id_col).select(*docs.columns)
