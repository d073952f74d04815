"""A pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediasieve.llm import decontaminate, language_id, mixing, ngram_join, token_records
from mediasieve.llm.scratch import scratch_dir, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null, without a letter, or with a score below 0.3."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five words, that with the smallest id stays.

    Rows without an id are in no group and stay, and so do rows that share the
    id that stays.
    """
    found = ngram_join.jaccard_components(docs, n=5, percent=80)
    gone = written(found.where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ``benchmark`` go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated, at most twice as often as any other, until the sources' mixture is as even as that allows.

    The budget is the smallest that draws every document at least once.
    """
    return mixing.realise(docs, mixing.mix_sources(docs, max_repeat=2.0, budget_ratio=None))


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in record files, and what reading them back gives for each record."""
    where = scratch_dir(spark, "pipeline-records")
    token_records.write_records(docs, where)
    return token_records.read_records(spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_records", write_token_records),
]

#: The first stage applies a trained network, which SQL can't express; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
