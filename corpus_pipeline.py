"""A training corpus from documents: filters, near-duplicates, decontamination, packing.

Each stage gets what its predecessor kept and returns the same columns; the last
one returns the packed pieces. Every stage's table is written to the shared
folder as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontaminate, pack, quality, simhash, toxicity
from riskframe.llm.common import read_table
from riskframe.session import materialize


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", not_in_benchmark),
    ("best_fit_packing", packed),
]

#: Trained models, hashes and a tokenizer decide; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
