"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown_lm, chat, embedding_dedup, exact_dedup, line_dedup, mixing, sharding, simhash_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat.digest_conversations(table.unionByName(planted))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def lm_scores(docs: DataFrame, **options) -> DataFrame:
    return brown_lm.score(docs, remainder("doc_id", 7) == 2, **options)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def remainder(id_col: str, modulus: int) -> Column:
    """CRC-32 of the decimal id, modulo; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that learns from the rows not held out."""
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).drop("row", "source")


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_chat": op4_chat,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    # Equal texts are those equal after normalisation: what block naming must agree with.
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
             g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256
        FROM t JOIN g USING (n)""",
}
