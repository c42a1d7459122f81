"""A training-data pipeline over ``documents``, one corpus operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of ``documents``; the last returns
token ids. ``run`` writes every stage's rows to the shared checkpoint folder and
reads them back, so a lost executor costs a stage's tasks and not the stages
before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.llm import bpe, copies, decontaminate, quality, secrets
from gistra.llm.common import shared_dir, small_batches, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on the labelled ones, rejects; without labels it rejects none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = quality.statistics_of(quality.labelled(docs.select("doc_id", "text"), labels))
    model = quality.fit(rows, labels)
    return quality.accept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five-word shingles, Jaccard 0.8).

    Operator 2's fingerprints and variants link first, checked by Jaccard; an exact search adds the links that they are too coarse for.
    """
    small_batches(spark)
    return copies.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items leaked into."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text; n_chars follows the text. No document is dropped."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of the round trip."""
    encoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary())
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("encoding", encoding),
]

#: SQL cannot express a fitted classifier; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
