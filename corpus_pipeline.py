"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

``STAGES`` lists them in order. A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` stores it
as Parquet and gives what it reads back to the next one. All but the last return the columns of
``documents``, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ruleflow.llm import classifier, decontamination, piece_coding, secret_scan, simhash
from ruleflow.storage import Scratch, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labelled ones, scores below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.keep_good(docs, classifier.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of ``op1_simhash`` (three-word shingles, three bits): the one with the smallest id."""
    return simhash.representatives(docs, simhash.WORDS, simhash.RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kind."""
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, round_trip)`` of every document that is left."""
    return piece_coding.code(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encode),
]

# Fingerprints, a fitted model and a search for the best segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return materialize(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")
