"""Lineage cuts in the folder that all machines share, and grouped kernels."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files at its end under this setting; what is cut stands in a table by then.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows in a file of a table whose size is known before it is written.
FILE_ROWS = 500_000
#: What a small table is made from: so many bytes of input a file, but so many files for each slot of the cluster at least.
FILE_BYTES, SLOT_FILES = 4 << 20, 2

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset a folder of our own is used if driver and executors are one process;
    on a cluster that is an error, since executors can't see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'reticula-checkpoints')}"


def few_files(df: DataFrame) -> int:
    """Files that a table of about the size of what it is made from needs: by the bytes of the sources of its plan."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(SLOT_FILES * df.sparkSession.sparkContext.defaultParallelism, read // FILE_BYTES + 1)


def pack(df: DataFrame, shuffled: bool = True) -> DataFrame:
    """``df`` in few partitions, and so few files, if it is small for the number it has; rows in any order.

    ``shuffled``: its last stage reads a shuffle.  That stage keeps its tasks, and its rows go to the
    files through an exchange of their own, if that makes them a fourth or less.  Other tables are made by fewer tasks.
    """
    few = few_files(df)
    if not shuffled:
        return df.coalesce(min(few, 1 << 20))
    return df.repartition(few) if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= 4 * few else df


def cut(df: DataFrame, by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost no rerun.

    ``by``: a column whose values get folders of their own, so that readers of one value open no other.
    ``rows``: no more rows than this are written; of narrow rows a file then holds FILE_ROWS on average,
    so a small table isn't dealt over as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/reticula/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    if _scopes:
        _scopes[-1].append((spark, path))
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            _delete(table.sparkSession, path)


@contextmanager
def scope() -> Iterator[None]:
    """Delete at the end what was cut inside: for callers who have written their result by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def per_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[tuple, pd.DataFrame], Iterable[tuple]], schema: str) -> DataFrame:
    """Run ``solve(key, rows)`` for every group, many small groups in one Python call.

    Rows are dealt by ``keys`` and sorted; groups are walked at their borders, so thousands of
    small networks cost one worker call.  One group must fit a worker: groups are single
    networks or blocks, whose solvers need them whole.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def solved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            out: list[tuple] = []
            for key, part in rows.groupby(keys, sort=False, dropna=False):
                out.extend(solve(key, part))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
            full = int(last[-1]) + 1 if len(last) else 0
            rest = frame.iloc[full:]
            if full:
                yield from solved(frame.iloc[:full])
        if rest is not None and len(rest):
            yield from solved(rest)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(kernel, schema)
