"""The driver's tables seen as networks.  Node ids are tag * 10^12 + key; the root is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 10**12
REGION, NATION, CUSTOMER, SUPPLIER, ORDER, TYPE, BRAND, PART, DAY, EVENT, TURN = range(1, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(tag: int, key: str | Column) -> Column:
    return F.lit(tag * UNIT) + (F.col(key) if isinstance(key, str) else key).cast("long")


def _edges(parts: list[DataFrame], net: Column) -> DataFrame:
    return reduce(DataFrame.union, parts).select(net.cast("long").alias("net_id"), "src", "dst", F.lit(None).cast("double").alias("length"))


def _arc(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def commerce(spark: SparkSession, d: str) -> DataFrame:
    """One network: root, regions, nations, customers and suppliers, orders (reticulations)."""
    t = lambda name: table(spark, d, name)
    return _edges([
        _arc(t("region"), F.lit(0), node(REGION, "r_regionkey")),
        _arc(t("nation"), node(REGION, "n_regionkey"), node(NATION, "n_nationkey")),
        _arc(t("customer"), node(NATION, "c_nationkey"), node(CUSTOMER, "c_custkey")),
        _arc(t("supplier"), node(NATION, "s_nationkey"), node(SUPPLIER, "s_suppkey")),
        _arc(t("orders"), node(CUSTOMER, "o_custkey"), node(ORDER, "o_orderkey")),
        _arc(t("lineitem"), node(SUPPLIER, "l_suppkey"), node(ORDER, "l_orderkey")).distinct(),
    ], F.lit(0))


def geo_tree(spark: SparkSession, d: str) -> DataFrame:
    """One tree: root, regions, nations, customers, orders."""
    t = lambda name: table(spark, d, name)
    return _edges([
        _arc(t("region"), F.lit(0), node(REGION, "r_regionkey")),
        _arc(t("nation"), node(REGION, "n_regionkey"), node(NATION, "n_nationkey")),
        _arc(t("customer"), node(NATION, "c_nationkey"), node(CUSTOMER, "c_custkey")),
        _arc(t("orders"), node(CUSTOMER, "o_custkey"), node(ORDER, "o_orderkey")),
    ], F.lit(0))


def geo_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of regions, nations and customers."""
    t = lambda name: table(spark, d, name)
    parts = [t("region").select(node(REGION, "r_regionkey").alias("node"), F.col("r_name").alias("label")),
             t("nation").select(node(NATION, "n_nationkey"), "n_name"), t("customer").select(node(CUSTOMER, "c_custkey"), "c_name")]
    return reduce(DataFrame.union, parts).select(F.lit(0).cast("long").alias("net_id"), "node", "label")


def part_tree_labels(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of one tree per part type: parts labelled by name (names repeat)."""
    return table(spark, d, "part").select(F.col("p_type").alias("type"), node(PART, "p_partkey").alias("node"), F.col("p_name").alias("label"))


def lattices(spark: SparkSession, d: str) -> DataFrame:
    """A network per order: root, its suppliers, their nations, their regions (leaves)."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("net_id"), F.col("l_suppkey").alias("s")).distinct()
    geo = (table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .select(F.col("s_suppkey").alias("s"), node(NATION, "n_nationkey").alias("n"), node(REGION, "n_regionkey").alias("r")))
    rows = line.join(geo, "s").withColumn("s", node(SUPPLIER, "s"))
    arcs = F.array(F.struct(F.lit(0).cast("long").alias("src"), F.col("s").alias("dst")), F.struct(F.col("s").alias("src"), F.col("n").alias("dst")), F.struct(F.col("n").alias("src"), F.col("r").alias("dst")))
    return (rows.select("net_id", F.explode(arcs).alias("a")).select("net_id", "a.src", "a.dst").distinct()
            .withColumn("length", F.lit(None).cast("double")))


def lattice_labels(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region").select(node(REGION, "r_regionkey").alias("dst"), F.col("r_name").alias("label"))
    return lattices(spark, d).select("net_id", "dst").distinct().join(regions, "dst").select("net_id", F.col("dst").alias("node"), "label")


def event_trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A tree per user: root, days, events; events labelled by type."""
    e = table(spark, d, "events").select(F.col("user_id").alias("net_id"), node(DAY, F.unix_date(F.to_date("ts"))).alias("day"), node(EVENT, "event_id").alias("event"), "event_type")
    edges = e.select("net_id", F.lit(0).cast("long").alias("src"), F.col("day").alias("dst")).distinct().union(e.select("net_id", "day", "event"))
    return edges.withColumn("length", F.lit(None).cast("double")), e.select("net_id", F.col("event").alias("node"), F.col("event_type").alias("label"))


def turn_chains(spark: SparkSession, d: str) -> DataFrame:
    """A chain per conversation: root, turn 0, turn 1, ...; lengths are text lengths."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("net_id"), "turn", F.length("text").cast("double").alias("length"))
    src = F.when(F.col("turn") == 0, F.lit(0)).otherwise(F.lit(TURN * UNIT) + F.col("turn") - 1)
    return c.select("net_id", src.cast("long").alias("src"), node(TURN, "turn").alias("dst"), "length").distinct()


def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, i, val): events of a user in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("seq_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("val"))


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    """(set_id, item): the parts of each supplier."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("item")).distinct()


#: The same networks in SQL, for the oracles.
SQL = {
    "fa": """fa AS (SELECT 0::BIGINT AS src, 1000000000000 + r_regionkey AS dst FROM region
        UNION ALL SELECT 1000000000000 + n_regionkey, 2000000000000 + n_nationkey FROM nation
        UNION ALL SELECT 2000000000000 + c_nationkey, 3000000000000 + c_custkey FROM customer
        UNION ALL SELECT 2000000000000 + s_nationkey, 4000000000000 + s_suppkey FROM supplier
        UNION ALL SELECT 3000000000000 + o_custkey, 5000000000000 + o_orderkey FROM orders
        UNION ALL (SELECT DISTINCT 4000000000000 + l_suppkey, 5000000000000 + l_orderkey FROM lineitem))""",
    "fb": """fb AS (SELECT 0::BIGINT AS src, 1000000000000 + r_regionkey AS dst FROM region
        UNION ALL SELECT 1000000000000 + n_regionkey, 2000000000000 + n_nationkey FROM nation
        UNION ALL SELECT 2000000000000 + c_nationkey, 3000000000000 + c_custkey FROM customer
        UNION ALL SELECT 3000000000000 + o_custkey, 5000000000000 + o_orderkey FROM orders)""",
    "fd": """fd0 AS (SELECT DISTINCT l_orderkey AS net_id, 4000000000000 + l_suppkey AS s, 2000000000000 + n_nationkey AS n, 1000000000000 + n_regionkey AS r
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
        fd AS (SELECT net_id, 0::BIGINT AS src, s AS dst FROM fd0 UNION SELECT net_id, s, n FROM fd0 UNION SELECT net_id, n, r FROM fd0)""",
    "fe": """fe AS (SELECT DISTINCT user_id AS net_id, 0::BIGINT AS src, 9000000000000 + date_diff('day', DATE '1970-01-01', ts::DATE) AS dst FROM events
        UNION ALL SELECT user_id, 9000000000000 + date_diff('day', DATE '1970-01-01', ts::DATE), 10000000000000 + event_id FROM events)""",
    "fg": """fg AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS val FROM events)""",
    "fh": """fh AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS item FROM lineitem)""",
}
