"""The corpus pipeline: documents to token ids in five stages.

Each stage gets what its predecessor kept, written as Parquet in between, and
returns the columns of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stockweave.llm import bag_minhash, bpe, exact_dedup, mixing, quality_rules
from stockweave.llm.common import read
from stockweave.llm.queries import vocabulary
from stockweave.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out and drops the documents that the rules reject."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents with equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near copies."""
    return bag_minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights; a document may come several times, or in part."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by their digests."""
    return bpe.digests(docs, *vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("encode", encoded),
]

#: Weighted signatures, seeded selection and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
