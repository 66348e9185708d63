"""The corpus pipeline: five stages from raw documents to token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from causalspark.llm.decontaminate import drop_contaminated
from causalspark.llm.exact_dedup import drop_copies
from causalspark.llm.frames import table
from causalspark.llm.quality import drop_rejected
from causalspark.llm.sentencepiece_fst import encode_decode
from causalspark.llm.simhash_dedup import drop_near_copies
from causalspark.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of the decoded text."""
    return encode_decode(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", copies), ("simhash_dedup", near_copies), ("benchmark_decontamination", clean), ("sentencepiece", encode)]

#: Not expressible: learned scores, fingerprints and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written as Parquet and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = f"{folder}/{number}_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
