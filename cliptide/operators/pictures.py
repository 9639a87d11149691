"""Order counters of pictures: unrolling the wrapped counter and presentation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .scan import ROWS_PER_CHUNK, div, ordered_scan


def wrap_step(lsb: Column, base: Column, modulus: int) -> Column:
    """What a low part adds to the high part, seen from the last reference picture's low part."""
    return (
        F.when((lsb < base) & (base - lsb >= modulus // 2), modulus)
        .when((lsb > base) & (lsb - base > modulus // 2), -modulus).otherwise(0)
    )


def unroll_order(pictures: DataFrame, modulus: int = 256, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Monotone order count from a wrapped one.

    Sequentially, each picture is compared with the last reference picture and only reference pictures
    move the base; a refresh picture resets it. As scans: the segment and the previous reference's low
    part first, then the sum of the reference pictures' wraps within the segment. The first scan is
    written out because the second reads it twice.
    """
    first = ordered_scan(
        pictures, ["clip_id"], ["decode_no"], div("decode_no", chunk_width),
        sums={"segment": F.col("idr").cast("bigint")}, befores={"_base": F.when(F.col("reference"), F.col("poc_lsb"))})
    base = F.when(F.col("idr") | F.col("_base").isNull(), 0).otherwise(F.col("_base"))
    step = first.withColumn("_step", wrap_step(F.col("poc_lsb"), base, modulus))
    moved = F.when(F.col("reference"), F.col("_step")).otherwise(0)
    high = ordered_scan(
        stage(step, "picture-scan"), ["clip_id", "segment"], ["decode_no"], div("decode_no", chunk_width), sums={"_high": moved})
    own = F.when(F.col("reference"), F.col("_high")).otherwise(F.col("_high") + F.col("_step"))
    return high.select("clip_id", "decode_no", "segment", "poc_lsb", (own + F.col("poc_lsb")).alias("poc"))


def presentation_order(pictures: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rank by order count inside each segment, and how far it is from the decode order."""
    start = pictures.groupBy("clip_id", "segment").agg(F.min("decode_no").alias("_first"))
    ranked = ordered_scan(pictures, ["clip_id", "segment"], ["poc", "decode_no"], div("poc", chunk_width), rank="_rank")
    return ranked.join(start, ["clip_id", "segment"]).select(
        "clip_id", "segment", "decode_no", "poc", (F.col("_rank") - 1).alias("present_no"),
        (F.col("_rank") - 1 - (F.col("decode_no") - F.col("_first"))).alias("displacement"))


def release_order(ordered: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Number of each picture in a clip's presentation order, across its segments, from ``presentation_order``."""
    sizes = stage(ordered.groupBy("clip_id", "segment").agg(F.count("*").alias("_n")), "segments")
    before = ordered_scan(sizes, ["clip_id"], ["segment"], div("segment", chunk_width), sums={"_upto": F.col("_n")})
    return ordered.join(before, ["clip_id", "segment"]).select(
        "clip_id", (F.col("_upto") - F.col("_n") + F.col("present_no") + 1).alias("release_no"), "decode_no", "poc")


def release_peak(pictures: DataFrame, depth: int) -> DataFrame:
    """Most pictures that wait at once where ``depth`` may wait for their turn, and pictures in all, per clip.

    A picture leaves as soon as one more than ``depth`` are there, and a segment lets all of its own go.
    """
    sizes = pictures.groupBy("clip_id", "segment").agg(F.count("*").alias("n"))
    return sizes.groupBy("clip_id").agg(F.least(F.max("n"), F.lit(depth + 1)).cast("bigint").alias("peak_waiting"), F.sum("n").alias("released"))
