"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontaminate, hyperminhash, langid, packing, surrogates
from trailmark.llm.common import Staging, bound_batches, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Below this multiple of a bare guess's confidence (one over the number of languages) the language is taken as unknown.
LEAST_TIMES = 1.2


def bounded(stage):
    """The stage, with small Arrow batches for the session that runs it.

    What a stage returns is computed only when its caller writes it, so the bounds stay set after the call.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language can't be told."""
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs.select(*COLUMNS), model)
    least = min(LEAST_TIMES / max(len(model.languages), 1), 1.0)  # a single language is certain
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


@bounded
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return hyperminhash.deduplicate(docs.select(*COLUMNS), width=5, percent=80, registers=512, band=7, borrow=True)


@bounded
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, also an edited one."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; ``n_chars`` follows the new text."""
    replaced = surrogates.pseudonymise(docs.select(*COLUMNS), "sample key")
    return replaced.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@bounded
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences with their tokens."""
    return packing.pack(docs, **vocabulary())


STAGES = [
    ("language", language_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

# Sketches, alignments and tokenizers are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written under the shared folder and the one before it deleted."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = staging.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if before:
            staging.drop(before)
        before = f"{i}-{name}"
    return docs
