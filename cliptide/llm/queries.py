"""The operators of this subpackage as registered queries, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load, stage
from . import bpe, decontaminate, langid, lpf, mixing, negatives, pages, periodic, quality, simhash, syncmer, url_list, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def _part(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def language_model(docs: DataFrame):
    """Learned from documents outside the held-out third."""
    return langid.fit(docs.where(_part(3) != 1).select("doc_id", "text", "lang"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    told = langid.identify(docs, language_model(docs))
    return told.select("doc_id", F.coalesce(_part(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stage(quality.statistics(load(spark, sf_dir, "documents")), "statistics")
    labels = load(spark, sf_dir, "labels").where(_part(4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(measured, quality.fit(measured, labels))
    return scored.select(
        "doc_id", F.coalesce(_part(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.robustness(load(spark, sf_dir, "documents"))


@query
def op6_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_list.screen(*url_list.derived_log(load(spark, sf_dir, "pages")))


ORACLE["op6_url_list"] = url_list.SQL


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.digest(lpf.dedup(load(spark, sf_dir, "documents")))


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passages(load(spark, sf_dir, "documents"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(load(spark, sf_dir, "pages"))


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(load(spark, sf_dir, "documents")))


ORACLE["op12_mixing"] = mixing.SQL


@query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapse(periodic.with_repeats(load(spark, sf_dir, "documents"))))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(load(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("id") % 50 == 0)


ORACLE["op13_hard_negatives"] = negatives.SQL
