"""The queries of the dealt operators with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (
    align, conversations, ctph, decontaminate, hyperminhash, langid, licences, packing, secrets, shards, suffixes, surrogates, token_counts,
)
from trailmark.llm.common import pieces, vocabulary


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), **vocabulary(), with_tokens=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced_shards(_docs(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_docs(spark, sf_dir), width=2, percent=80, borrow=True).drop("text_hash")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key is an argument of the operator; a secret one belongs in a deployment's own configuration.
    out = surrogates.pseudonymise(_docs(spark, sf_dir).select("doc_id", "text"), "sample key")
    return out.select("doc_id", "text", "n_entities")


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_docs(spark, sf_dir), **vocabulary(), rule="majority")


def op4_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_neighbours(_docs(spark, sf_dir)).drop("next_fingerprint")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_docs(spark, sf_dir), licences.public_licences(spark))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_docs(spark, sf_dir), length=400, keep="none", passage=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_docs(spark, sf_dir))
    return found.select(
        "doc_id", *(secrets.of_kind(k).alias(f"n_{k}") for k in secrets.BASE_KINDS),
        F.sha2(secrets.listed(*secrets.BASE_KINDS), 256).alias("base_sha256"), secrets.listed().alias("spans"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repaired(conversations.damaged(rows), rows)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.scored(_docs(spark, sf_dir), **vocabulary(), **pieces())


QUERIES = {
    "op1_repeats": op1_repeats,
    "op6_licences": op6_licences,
    "op2_section_tokens": op2_section_tokens,
    "op4_piecewise_hash": op4_piecewise_hash,
    "op3_surrogates": op3_surrogates,
    "op5_near_duplicates": op5_near_duplicates,
    "op8_language": op8_language,
    "op10_decontamination": op10_decontamination,
    "op7_packing": op7_packing,
    "op9_sharding": op9_sharding,
    "op11_secrets": op11_secrets,
    "op12_conversations": op12_conversations,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op6_licences": licences.oracle()}
