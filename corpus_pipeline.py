"""From raw documents to packed training sequences, stage by stage.

Every stage takes what the one before it kept, is written as Parquet and read
again. The operators are those of ``pairloom.llm``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.exact_dedup import drop_exact_duplicates
from pairloom.llm.importance import keep_good
from pairloom.llm.mixing import mixed_documents
from pairloom.llm.near_dedup import drop_near_duplicates
from pairloom.llm.packing import pack_documents
from pairloom.operators.staging import shared_folder
from pairloom.shipping import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target shares: documents appear as often as taken."""
    ship_package(spark)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    ship_package(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

# Signatures, sampling and packing are not expressible in SQL. The operators have
# tests of their own; those of the stages check which documents each one passes on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
