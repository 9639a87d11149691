"""Exact frame and sample arithmetic as column expressions.

Rates are a numerator and a denominator and are never turned into floating point. A product that would
pass 64 bits is split at the whole periods, ``frame * den = q * num + r``, so everything stays BIGINT
inside generated code (DECIMAL arithmetic was four times slower); ANSI mode raises on overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import div

NS_PER_SECOND = 1_000_000_000
# A frame range is opened in two steps so that no single array grows with the clip.
EXPLODE_STEP = 1 << 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scaled(frame: Column, scale: Column | int, num: Column, den: Column) -> Column:
    """``floor(frame * den * scale / num)`` without forming the whole product."""
    periods, n = frame.cast("bigint") * den, num.cast("bigint")
    return div(periods, n) * scale + div((periods % n) * scale, n)


def offset_ns(frame: Column, num: Column, den: Column) -> Column:
    """Start of a frame in nanoseconds, floored."""
    return _scaled(frame, NS_PER_SECOND, num, den)


def sample_at(frame: Column, sample_rate: Column, num: Column, den: Column) -> Column:
    """First sample of a frame: adjacent floor boundaries, so neighbouring frames never overlap."""
    return _scaled(frame, sample_rate, num, den)


def interval_ns(num: Column, den: Column) -> Column:
    """Frame interval rounded up; null when either part of the rate is zero."""
    n = num.cast("bigint")
    return F.when((num != 0) & (den != 0), div(den.cast("bigint") * NS_PER_SECOND + n - 1, n))


def due_frame(elapsed_ms: Column, start: Column, end: Column, num: Column, den: Column) -> Column:
    """Latest frame due after ``elapsed_ms``, never past the last frame of ``[start, end)``."""
    return F.least(start + div(elapsed_ms.cast("bigint") * num, den.cast("bigint") * 1000), end - 1)


def rates_equal(a_num: Column, a_den: Column, b_num: Column, b_den: Column, strict: bool = False) -> Column:
    """Equal after reduction; ``strict`` compares the parts as they stand."""
    if strict:
        return (a_num == b_num) & (a_den == b_den)
    return a_num.cast("bigint") * b_den == b_num.cast("bigint") * a_den


def media_time_text(frame: Column, num: Column, den: Column) -> Column:
    """``HH:MM:SS.mmm`` of a frame's start."""
    ms = div(offset_ns(frame, num, den), 1_000_000)
    return F.format_string(
        "%02d:%02d:%02d.%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000
    )


def ms_to_sample(ms: Column, sample_rate: Column | int) -> Column:
    return div(ms.cast("bigint") * sample_rate, 1000)


def explode_range(df: DataFrame, start: Column | str, end: Column | str, name: str) -> DataFrame:
    """One row per integer of ``[start, end)``; rows with an empty range give none."""
    s, e = _col(start).cast("bigint"), _col(end).cast("bigint")
    outer = df.withColumns({"_s": s, "_e": e}).where("_s < _e").withColumn(
        "_from", F.explode(F.sequence("_s", F.col("_e") - 1, F.lit(EXPLODE_STEP).cast("bigint")))
    )
    inner = F.explode(F.sequence("_from", F.least(F.col("_from") + EXPLODE_STEP, F.col("_e")) - 1))
    return outer.withColumn(name, inner).drop("_s", "_e", "_from")


def frame_timeline(clips: DataFrame) -> DataFrame:
    """One row per frame with its start time."""
    frames = explode_range(clips, F.lit(0), "duration_frames", "frame")
    return frames.withColumn("offset_ns", offset_ns(F.col("frame"), F.col("rate_num"), F.col("rate_den")))


def frame_samples(clips: DataFrame) -> DataFrame:
    """One row per frame with its half-open audio sample range."""
    at = lambda f: sample_at(f, F.col("sample_rate"), F.col("rate_num"), F.col("rate_den"))
    return explode_range(clips, F.lit(0), "duration_frames", "frame").withColumns(
        {"start_sample": at(F.col("frame")), "end_sample": at(F.col("frame") + 1)}
    )


def due_drain(ticks: DataFrame) -> DataFrame:
    """Frames falling due between two ticks, for ``mode`` forward, still, reverse or double.

    ``ticks`` has range_start, range_end, rate_num, rate_den, last_ms (null before the first tick),
    now_ms and mode. Forward and double move up from the range start, at one or two frames per frame
    period, and never pass the last frame. Reverse moves down from the last frame and never passes the
    start. A still tick moves nothing. The first tick also yields the frame it starts on.
    """
    n, d = F.col("rate_num"), F.col("rate_den")
    speed = F.when(F.col("mode") == "double", 2).when(F.col("mode") == "still", 0).otherwise(1)
    moved = lambda ms: div(ms.cast("bigint") * n * speed, d.cast("bigint") * 1000)
    span = F.col("range_end") - F.col("range_start")
    first = F.when(F.col("last_ms").isNull(), 0).otherwise(F.least(moved(F.col("last_ms")), span - 1) + 1)
    last = F.least(moved(F.col("now_ms")), span - 1)
    open_ticks = ticks.where((F.col("range_start") < F.col("range_end")) & (F.col("mode") != "still"))
    steps = explode_range(open_ticks, first, last + 1, "step")
    frame = F.when(F.col("mode") == "reverse", F.col("range_end") - 1 - F.col("step")).otherwise(
        F.col("range_start") + F.col("step")
    )
    return steps.withColumn("frame", frame)
