"""A corpus pipeline of operators of ``reticula.llm``: stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its
result is written as Parquet, in few files if it is small, and read again.  All but the last return the columns of
``documents``, extra ones among them whatever their names.

Cases: a null text is the empty text to every stage and stays null in what they return; ids
and sources may be null or repeat; texts of any length are read whole; an empty table stays
empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reticula.llm import bpe, exact_dedup, mixing, queries, simhash_dedup, toxicity
from reticula.llm.common import cut, pack


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.  The model learns from labelled rows among ``docs`` that are not held out.

    Null and empty texts score as texts without clauses; without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(queries.remainder("doc_id", 5) != 0)
    return pack(toxicity.remove_toxic(docs, toxicity.fit(docs, labels)), shuffled=False)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space runs count as one space) the smallest id stays.

    Null and empty texts are one group; a null id ranks last; of rows equal in id and text one stays.
    """
    return pack(exact_dedup.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id.

    Null and wordless texts have the fingerprint zero and link like others; a null id ranks last.
    """
    return pack(simhash_dedup.dedup(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for the mix, repeated as often as taken, in training order.

    Null sources are one source; a document without words is taken as often as its source's whole passes.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as counts and digests.

    Null and empty texts have no tokens and the digests of the empty string; repeated rows give a row each.
    """
    return pack(bpe.encode(docs, queries.vocabulary(), digest=True), shuffled=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", exact),
    ("simhash_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages fit models and link fingerprints, which SQL can't express; tests hold run()
#: against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
