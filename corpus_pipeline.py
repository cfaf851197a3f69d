"""Corpus pipeline: quality rules, near-duplicates, personal data, source mix, token pieces.

Every stage takes the documents that its predecessor kept and lets its decisions take effect: rejected documents and all but
one of a near-duplicate class go, personal data is replaced in the texts, and a document is repeated as often as the mix takes
it.  The last stage adds the piece ids of the final texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfind.llm.common import shared_folder, small_batches
from wayfind.llm.mixing import apply_mix
from wayfind.llm.personal_data import redact
from wayfind.llm.piece_lattice import encode_documents, load_model
from wayfind.llm.quality_rules import keep_documents
from wayfind.llm.weighted_minhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie above their stratum's cutoff go."""
    small_batches(spark)
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates stays."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return apply_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the piece ids of their texts."""
    small_batches(spark)
    return encode_documents(docs, load_model(public_tokenizers.path("piece_bpe_32k.model")), "piece_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pieces", pieces),
]
#: No SQL twin: learned thresholds, sketches, a trained classifier and merges have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
