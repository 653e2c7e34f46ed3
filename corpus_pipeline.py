"""The corpus pipeline: quality rules, near duplicates, secrets, source mix, packing.

Every stage takes the documents that the stage before kept and decides for good: rejected documents, all but one of
each group of near duplicates and what the mix leaves out are gone, secrets are masked, documents the mix repeats come
as often as it says. All stages but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import ngram_join, packing, quality_rules, secret_scan, source_mix
from causeway.llm.common import read, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, part=80, whole=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secret_scan.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents leave or repeat so that sources meet their target weights."""
    return source_mix.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces of documents."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("secret scans", secrets),
          ("source mix", mix), ("packing", pack)]

#: Forests, hashed joins and a tokenizer are no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
