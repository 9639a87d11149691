"""Late and dropped frames, stage cost, queues and preview slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import presentation
from .scan import ROWS_PER_CHUNK, div, ordered_scan


def reconcile(decisions: DataFrame) -> DataFrame:
    """Decisions per run: every source frame is presented, late, dropped or duplicated, exactly once."""
    label = F.when(F.col("duplicated"), "Duplicated").otherwise(presentation(F.col("lateness_ms")))
    n = lambda x: F.count_if(F.col("label") == x)
    return decisions.withColumn("label", label).groupBy("run_id").agg(
        n("OnTime").alias("presented"), n("Late").alias("late"), n("Dropped").alias("dropped"),
        n("Duplicated").alias("duplicated"), (F.max("frame") + 1).alias("source_frames"),
    ).withColumn("reconciled", F.col("presented") + F.col("late") + F.col("dropped") + F.col("duplicated") == F.col("source_frames"))


def lateness_distribution(decisions: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Exact maximum, mean, median and p90 per run.

    Rows are reduced map-side to one per distinct lateness (in microseconds), the counts are summed in
    order, and a quantile is the value whose running count covers its rank. No task holds a run.
    """
    micro = F.round(F.col("lateness_ms") * 1000).cast("bigint")
    counts = decisions.groupBy("run_id", micro.alias("us")).agg(F.count("*").alias("n"))
    ranked = ordered_scan(counts, ["run_id"], ["us"], div("us", chunk_width), sums={"upto": F.col("n")})
    totals = counts.groupBy("run_id").agg(F.sum("n").alias("rows"))
    at = lambda i: F.max(F.when((F.col("upto") - F.col("n") <= i) & (i < F.col("upto")), F.col("us")))
    last = F.col("rows") - 1
    # Linear interpolation between the two ranks around p * (rows - 1), with p as tenths.
    low = lambda tenths: div(last * tenths, 10)
    picks = [at(F.least(low(p) + k, last)).alias(f"q{p}_{k}") for p in (5, 9) for k in (0, 1)]
    between = lambda p: F.round(
        (F.col(f"q{p}_0") + (F.col(f"q{p}_1") - F.col(f"q{p}_0")) * (last * p % 10) / 10) / 1000, 6)
    return ranked.join(totals, "run_id").groupBy("run_id", "rows").agg(
        F.max("us").alias("top"), F.sum(F.col("us") * F.col("n")).alias("sum_us"), *picks
    ).select(
        "run_id", F.round(F.col("top") / 1000, 6).alias("max_ms"),
        F.round(F.col("sum_us") / F.col("rows") / 1000, 6).alias("mean_ms"),
        between(5).alias("median_ms"), between(9).alias("p90_ms"))


def lateness_sketch(decisions: DataFrame, accuracy: int = 10000) -> DataFrame:
    """The same quantiles from a mergeable sketch, for runs with very many distinct values."""
    q = F.percentile_approx("lateness_ms", [0.5, 0.9], accuracy)
    return decisions.groupBy("run_id").agg(F.max("lateness_ms").alias("max_ms"), q.alias("q")).select(
        "run_id", "max_ms", F.col("q")[0].alias("median_ms"), F.col("q")[1].alias("p90_ms"))


def stage_breakdown(timings: DataFrame, rate_num: int = 50, rate_den: int = 1) -> DataFrame:
    """Total, average and share per stage with the run's frames per second and realtime factor.

    The share divides two aggregates, so no window over raw timings is needed.
    """
    us = F.round(F.col("ms") * 1000).cast("bigint")
    stages = timings.groupBy("run_id", "stage").agg(F.sum(us).alias("us"), F.count("*").alias("frames"))
    runs = stages.groupBy("run_id").agg(F.sum("us").alias("run_us"), F.sum("frames").alias("run_frames"))
    fps = F.col("run_frames") * 1_000_000 / F.col("run_us")
    return stages.join(runs, "run_id").select(
        "run_id", "stage", "frames", F.round(F.col("us") / 1000, 6).alias("total_ms"),
        F.round(F.col("us") / F.col("frames") / 1000, 6).alias("avg_ms"),
        F.round(F.try_divide("us", "run_us"), 6).alias("share"), F.round(fps, 6).alias("fps"),
        F.round(fps * rate_den / rate_num, 6).alias("realtime"))


def _queue(log: DataFrame, key: str, chunk_width: int, **more) -> DataFrame:
    step = F.when(F.col("op") == "create", 1).otherwise(-1)
    return ordered_scan(log, [key], ["seq", "resource_id", "op"], div("seq", chunk_width), sums={"depth": step}, **more)


def queue_depth(log: DataFrame, key: str, capacity: int, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Running depth of what is created and not yet destroyed, per key."""
    return _queue(log, key, chunk_width).withColumn("backpressure", (F.col("op") == "create") & (F.col("depth") > capacity))


def queue_summary(log: DataFrame, key: str, capacity: int, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Peak, time above capacity in units of ``seq``, entries above it and refusals, per key, in one scan of the log."""
    seen = _queue(log, key, chunk_width, lags={"seq_before": F.col("seq")})
    created = F.col("op") == "create"
    depth_before = F.col("depth") - F.when(created, 1).otherwise(-1)
    above = F.when(F.col("seq_before").isNotNull() & (depth_before > capacity), F.col("seq") - F.col("seq_before")).otherwise(0)
    return seen.groupBy(key).agg(
        F.max("depth").alias("peak"), F.sum(above).alias("time_above"), F.count_if(F.col("depth") > capacity).alias("above_capacity"),
        F.count_if(created & (F.col("depth") > capacity)).alias("backpressure"))


def selection_completeness(source: DataFrame, selected: DataFrame, skipped: DataFrame) -> DataFrame:
    """Are selected and skipped frames disjoint and together all source frames, per run.

    Three tables (run_id, frame) that know nothing of each other: their union is reduced per (run, frame), and what is not
    covered exactly once, or is in no source, shows up in the counts.
    """
    sides = [t.select("run_id", "frame", F.lit(n).alias("side")) for n, t in enumerate((source, selected, skipped))]
    has = lambda s: F.max((F.col("side") == s).cast("int"))
    tagged = sides[0].unionByName(sides[1]).unionByName(sides[2])
    per_frame = tagged.groupBy("run_id", "frame").agg(has(0).alias("src"), has(1).alias("sel"), has(2).alias("skip"))
    return per_frame.groupBy("run_id").agg(
        F.sum("sel").alias("selected"), F.sum("skip").alias("skipped"), F.sum("src").alias("source"),
        F.count_if((F.col("sel") == 1) & (F.col("skip") == 1)).alias("in_both"),
        F.count_if((F.col("src") == 1) & (F.col("sel") + F.col("skip") == 0)).alias("in_neither"),
        F.count_if(F.col("src") == 0).alias("not_in_source"))


def presentation_slots(video: DataFrame, audio: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """The n-th selected video slot with the n-th audio slot; ready when both are."""
    v = ordered_scan(video, ["run_id"], ["frame"], div("frame", chunk_width), rank="slot")
    a = ordered_scan(audio, ["run_id"], ["packet_no"], div("packet_no", chunk_width), rank="slot")
    both = v.join(a, ["run_id", "slot"], "left")
    status = (
        F.when(F.col("video_status") != "Prepared", F.col("video_status"))
        .when(F.col("packet_no").isNull(), "MissingAudio").when(~F.col("audio_complete"), "IncompleteAudio")
        .otherwise("Ready")
    )
    return both.select("run_id", (F.col("slot") - 1).alias("slot"), "frame", "packet_no", status.alias("status"))
