"""Newick lines as a stream of files: stateless parsing, network operators per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.newick import parse_table


def newick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed networks of text files as they arrive; net_id from the line."""
    lines = spark.readStream.text(path)
    return parse_table(lines.select(F.xxhash64("value").alias("net_id"), "value"))


def run_per_batch(parsed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply a network operator to each micro-batch of whole networks."""
    return parsed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
