"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``: the
rows its predecessor kept, written as Parquet and reread.  All but the last
return the columns of documents.  ``run`` removes a stage's staged tables when its
result is written, and that result when the next stage's is; what the last stage
reads stays, as its result is the caller's to write.  Each run has folders of its
own, so runs do not meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkthrift.llm import op1_packing, op5_toxicity, op6_jaccard, op8_mixing, op10_dedup
from sparkthrift.llm.common import release, remove, scope, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator rejects."""
    return op5_toxicity.nontoxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the one with the largest doc_id."""
    return op10_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the one with the smallest doc_id."""
    return op6_jaccard.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their targets: a document comes as often as it is taken."""
    return op8_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences; one row per piece."""
    return op1_packing.pack(docs, **op1_packing.public_tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Neither the classifier nor the tokens can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    folder = f"{shared_dir(spark)}-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        with scope(name) as own:
            function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, own)
        if before:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    with scope(STAGES[-1][0]):
        return STAGES[-1][1](spark, docs, sf_dir)
