"""The corpus pipeline: quality rules, quality classifier, near and passage dedup, packing.

Each stage takes all that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwater.llm import minhash, packing, quality_model, quality_rules, substring
from tillwater.llm.common import tidy
from tillwater.session import ensure_checkpoint_dir


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, and so do documents that lose too much or break a rule on the whole text."""
    return quality_rules.keep_good(docs)


def by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for bad go. It learns from the labels over the raw documents.

    The rows labelled for tests only take no part in training.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_model.keep_good(docs, quality_model.fit(raw, labels))


def by_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    tidy(spark)
    return minhash.keep_one(docs, share=0)


def by_passage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out."""
    tidy(spark)
    return substring.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    import public_tokenizers as public

    pieces = packing.pack(docs, public.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", by_rules), ("quality classifier", by_model), ("near dedup", by_class),
    ("substring dedup", by_passage), ("packing", packed),
]

#: Compression, sampling and tokenizers can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{at}")
            docs = spark.read.parquet(f"{base}/{at}")
    return docs
