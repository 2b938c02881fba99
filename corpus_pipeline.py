"""The corpus pipeline: quality, exact copies, near copies, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import exact, mixing, near, packing, quality
from skyledger.llm.common import remainder
from skyledger.session import configure, stage

Docs = DataFrame


def keep_quality(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that the classifier scores 0.7 or more; it learns from three quarters of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return quality.keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Of equal texts the row with the largest doc_id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Of each group of near copies the row with the smallest doc_id."""
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents as often, and as far, as the target of their source asks."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

# The classifier, the near copies and the vocabulary have no SQL; tests/llm holds the stages against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table that the next one reads."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
