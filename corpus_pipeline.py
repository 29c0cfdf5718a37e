"""Corpus cleaning: the stages in their order, each over all its predecessor kept.

Defined cases: documents without a text pass every stage and end with an empty decoded text and no tokens; documents without an id are not
touched by line dedup and are told apart by their text in near-dedup; repeated rows become one; a text whose lines all go stays, empty;
columns beside those of ``documents`` pass, unless named ids or n_tokens; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op2_lines, op3_bpe, op6_minhash, op8_decontaminate, op10_toxicity
from tessera.llm.common import drop_files, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from the labels of the given tables."""
    model = op10_toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op10_toxicity.keep_clean(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines one stays; the documents' texts are rebuilt, and n_chars with them."""
    return op2_lines.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op6_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to the edit budget, go."""
    return op8_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, and the text as decoded from them."""
    return op3_bpe.encode(docs, decoded=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]
#: Learnt scores and merges are beyond SQL; run() is tested against a brute-force chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/tessera-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_files(spark, before)  # the stage has read them
        before = path
    return docs
