"""From raw documents to token ids: language, near copies, repeated passages, benchmark leaks, tokens.

Each stage is written as Parquet to the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliptide.llm import stages
from cliptide.sources import load, stage

STAGES = [
    ("language", stages.language),
    ("near_copies", stages.near_copies),
    ("passages", stages.passages),
    ("benchmark_leaks", stages.benchmark_leaks),
    ("token_ids", stages.token_ids),
]

#: SQL cannot state the language models or the tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
