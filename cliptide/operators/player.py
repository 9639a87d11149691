"""Command replays and what is derived from their output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import lane_label
from ..functions.timing import interval_ns
from . import machines
from .fold import ordered_fold
from .scan import ROWS_PER_CHUNK, div, ordered_scan

ROWS_PER_BLOCK = 1 << 18

# Fault kind -> severity, scope, recoverable, recommended action.
FAULTS = {
    "IllegalCommandForState": ("Recoverable", "Command", True, "PrepareAgain"),
    "SourceNotLoaded": ("Recoverable", "Source", True, "UnloadAndReload"),
    "SourceAlreadyLoaded": ("Recoverable", "Source", True, "StopThenUnload"),
    "StaleSourceHandle": ("Recoverable", "Source", True, "UnloadAndReload"),
    "StaleGeneration": ("Recoverable", "Session", True, "UnloadAndReload"),
    "CueOutsideActiveRange": ("Recoverable", "Timing", True, "ReCue"),
    "SeekOutsideActiveRange": ("Recoverable", "Timing", True, "SeekToValidRange"),
    "PrepareRequired": ("Recoverable", "Prepare", True, "RetryCommandAfterPrepare"),
    "PrepareFailed": ("Recoverable", "Prepare", True, "PrepareAgain"),
    "PreparedWindowUnderrun": ("Recoverable", "Buffer", True, "PrepareAgain"),
    "PreparedWindowEmpty": ("Recoverable", "Buffer", True, "PrepareAgain"),
    "EndOfRangeReached": ("Info", "Playback", True, "NoActionRequired"),
    "BackendNotImplemented": ("Warning", "Device", True, "WaitForBackendImplementation"),
    "RealDisplayUnavailable": ("Warning", "Device", True, "UseDiagnosticBackendOnly"),
    "AudioOutputNotProductionVerified": ("Warning", "Device", True, "UseDiagnosticBackendOnly"),
    "VisualVerificationUnavailable": ("Warning", "Device", True, "UseDiagnosticBackendOnly"),
    "RealtimeVerificationUnavailable": ("Warning", "Timing", True, "UseDiagnosticBackendOnly"),
    "AvSyncNotVerified": ("Warning", "Timing", True, "UseDiagnosticBackendOnly"),
    "PrivatePathExposureBlocked": ("Recoverable", "Session", True, "NoActionRequired"),
    "UnsupportedOsBackend": ("Warning", "Device", True, "SelectDifferentDevicePolicy"),
    "ProxyAudioNotAuthoritative": ("Recoverable", "Source", True, "UnloadAndReload"),
}


def replay(commands: DataFrame, block_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """Outcome and state after every command of every session; range_start and range_end come with each command."""
    return ordered_fold(commands, ["session_id"], ["seq"], machines.player(), div("seq", block_rows))


def lifecycle_replay(ops: DataFrame, block_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    return ordered_fold(ops, ["session_id"], ["seq"], machines.lifecycle(), div("seq", block_rows))


def source_replay(ops: DataFrame, block_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    return ordered_fold(ops, ["session_id"], ["seq", "sub"], machines.source_lifecycle(), div("seq", block_rows))


def coverage_replay(ticks: DataFrame, block_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    return ordered_fold(ticks, ["session_id"], ["seq"], machines.coverage(), div("seq", block_rows))


def generation_numbers(outcomes: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Running count of accepted commands that change state; observers do not advance it."""
    advances = (F.col("accepted") & (F.col("command") != "Snapshot")).cast("bigint")
    return ordered_scan(
        outcomes.select("session_id", "seq", "command", "accepted"), ["session_id"], ["seq"], div("seq", chunk_width),
        sums={"generation": advances})


def latest_snapshot(outcomes: DataFrame) -> DataFrame:
    """State after the last command of each session: an aggregate, not a ranking."""
    cols = ("seq", "status", "frame", "armed", "generation")
    return outcomes.groupBy("session_id").agg(F.max_by(F.struct(*cols), "seq").alias("s")).select("session_id", "s.*")


def state_changes(outcomes: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows where the status differs from the one before, which is null at the start."""
    seen = ordered_scan(
        outcomes.select("session_id", "seq", "status"), ["session_id"], ["seq"], div("seq", chunk_width),
        lags={"previous": F.col("status")})
    return seen.where(~F.col("status").eqNullSafe(F.col("previous")))


def transition_counts(changes: DataFrame) -> DataFrame:
    return changes.where("previous is not null").groupBy("previous", "status").agg(F.count("*").alias("times"))


def command_counters(outcomes: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Accepted and rejected commands per session, and rejections that changed state, which must be 0."""
    watched = F.struct("status", "loaded", "has_range", "frame", "armed", "generation", "range_start", "range_end")
    seen = ordered_scan(
        outcomes, ["session_id"], ["seq"], div("seq", chunk_width), lags={"before": watched}
    )
    empty = F.struct(F.lit("Empty").alias("status"), F.lit(False).alias("loaded"), F.lit(False).alias("has_range"),
                     F.lit(None).cast("bigint").alias("frame"), F.lit(False).alias("armed"), F.lit(0).cast("bigint").alias("generation"),
                     *[F.lit(None).cast("bigint").alias(n) for n in ("range_start", "range_end")])
    changed = ~watched.eqNullSafe(F.coalesce("before", empty))
    return seen.groupBy("session_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(~F.col("accepted") & changed).alias("mutated_by_rejection"))


def fault_dimension(spark) -> DataFrame:
    rows = [(k, *v) for k, v in FAULTS.items()]
    return spark.createDataFrame(rows, "reason string, severity string, scope string, recoverable boolean, action string")


def enrich_faults(outcomes: DataFrame) -> DataFrame:
    """Rejections with severity, scope, recoverability and action.

    The dimension is the 21 fixed rows above, so broadcasting it is bounded by construction.
    """
    faults = outcomes.where("reason is not null").select("session_id", "seq", "command", "reason")
    return faults.join(F.broadcast(fault_dimension(outcomes.sparkSession)), "reason", "left")


def fault_counters(faults: DataFrame) -> DataFrame:
    """Counts by severity and scope with totals, the last fault, recoverable and fatal counts."""
    return faults.groupBy("severity", "scope", "reason").agg(
        F.count("*").alias("n"), F.max(F.struct("seq", "session_id")).alias("last"),
        F.count_if("recoverable").alias("r"), F.count_if(F.col("severity") == "Fatal").alias("f"),
    ).cube("severity", "scope").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("faults"),
        F.max_by("reason", F.struct("last", "reason")).alias("last_fault"), F.sum("r").alias("recoverable"),
        F.sum("f").alias("fatal"))


LANE = "struct<lane_index:int,label:string,source_track_index:int,source_channel_index:int>"


def source_lanes(lane_count: Column, channels_per_track: int = 2) -> Column:
    """Labelled lanes of a source whose channels are numbered through its tracks; none for a null or zero count."""
    lane = lambda i: F.struct(
        i.alias("lane_index"), lane_label(i).alias("label"), div(i, channels_per_track).cast("int").alias("source_track_index"),
        (i % channels_per_track).alias("source_channel_index"))
    return F.when(lane_count > 0, F.transform(F.sequence(F.lit(0), lane_count - 1), lane)).otherwise(F.array().cast(f"array<{LANE}>"))


def passive_view(snapshots: DataFrame) -> DataFrame:
    """What an observer may see of a session: monitor, timeline, wave and status block.

    Everything is blank where a private path shows or proxy audio claims authority, and a picture needs visual
    verification. The playhead is never invented. Lanes and sample cursor are shown for original audio only, the URI and
    labels while a source is loaded. ``last_rejection`` is the refusal of the row's own command, which an accepted
    command clears.
    """
    c = F.col
    hidden = c("private_path_exposed") | c("proxy_aac_authoritative")
    confirmed = c("loaded") & c("frame").isNotNull() & (c("rate_num") > 0) & (c("rate_den") > 0)
    real_range = c("loaded") & c("has_range") & (c("range_start") < c("range_end"))
    presented = c("visual_verified") & c("frame").isNotNull()
    original = c("loaded") & (c("audio_authority") == "Original")
    mode = F.when(c("source_mode") == "OriginalMedia", "original").when(c("source_mode") == "ProxyPreview", "proxy").otherwise("none")
    no_lanes = F.array().cast(f"array<{LANE}>")
    # Name -> (value, what a hidden row shows instead).
    shown = {
        "monitor": (F.when(presented, "picture").when(c("loaded"), F.concat(F.lit("status:"), "status")).otherwise("empty"), "empty"),
        "monitor_frame": (F.when(presented, c("frame")), None),
        "timeline_start": (F.when(real_range, c("range_start")).otherwise(0), 0),
        "timeline_frames": (F.when(real_range, c("range_end") - c("range_start")).when(c("loaded"), 1).otherwise(0), 0),
        "playhead": (F.when(c("loaded"), c("frame")), None),
        "cue_enabled": (confirmed, False),
        "wave": (F.when(original, "original").otherwise("none"), "none"),
        "lanes": (F.when(original, F.coalesce("lanes", no_lanes)).otherwise(no_lanes), no_lanes),
        "sample_start": (F.when(original, c("sample_start")), None),
        "sample_end": (F.when(original, c("sample_end")), None),
        "transport": (c("status"), "Empty"),
        "public_uri": (F.when(c("loaded"), c("public_uri")), None),
        "picture": (F.when(c("loaded"), mode).otherwise("none"), "none"),
        "audio": (F.when(c("loaded"), F.coalesce("audio_authority", F.lit("none"))).otherwise("none"), "none"),
        "play_enabled": (c("transport_ready") & confirmed, False),
        "pause_enabled": (c("status") == "Playing", False),
        "source_loaded": (c("loaded"), False),
        "prepared_frames": (c("prepared_frames"), 0),
        "video_payload_ready": (c("video_payload_ready"), False),
        "audio_payload_ready": (c("audio_payload_ready"), False),
        "presented": (presented, False),
        "last_rejection": (c("reason"), None),
        **{f"{n}_verified": (c(f"{n}_verified"), False) for n in ("realtime", "visual", "audio_device", "av_sync")},
    }
    return snapshots.select("session_id", "seq", *[F.when(hidden, blank).otherwise(e).alias(n) for n, (e, blank) in shown.items()])


def client_predicates(snapshots: DataFrame) -> DataFrame:
    """Confirmed position, ready, can start, playing, frame interval, and the refusal that a client shows as its error.

    The error is shown on hidden rows too: it is a kind of fault and names no source.
    """
    c = F.col
    confirmed = (
        c("loaded") & c("frame").isNotNull() & c("has_range") & (c("range_start") < c("range_end"))
        & (c("rate_num") > 0) & (c("rate_den") > 0) & ~c("private_path_exposed") & ~c("proxy_aac_authoritative")
    )
    ready = confirmed & c("transport_ready")
    return snapshots.select(
        "session_id", "seq", confirmed.alias("confirmed_position"), ready.alias("ready"), ready.alias("can_start"),
        (c("status") == "Playing").alias("playing"),
        F.when(confirmed, interval_ns(c("rate_num"), c("rate_den"))).alias("interval_ns"), c("reason").alias("error"))


def duplicate_commands(commands: DataFrame) -> DataFrame:
    return commands.groupBy("session_id", "command_id").agg(F.count("*").alias("copies")).where("copies > 1")


def sequence_audit(events: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Sequence numbers strictly increasing without gaps, generation never decreasing."""
    seen = ordered_scan(
        events, ["session_id"], ["seq"], div("seq", chunk_width),
        lags={"prev_seq": F.col("seq"), "prev_generation": F.col("generation")})
    status = (
        F.when(F.col("prev_seq").isNull(), "first").when(F.col("seq") <= F.col("prev_seq"), "not-increasing")
        .when(F.col("seq") > F.col("prev_seq") + 1, "gap").otherwise("ok"))
    back = F.coalesce(F.col("generation") < F.col("prev_generation"), F.lit(False))
    return seen.withColumns({"status": status, "generation_back": back})


def prepared_window(ticks: DataFrame, back: int = 2, ahead: int = 5, most: int = 8, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Prepared frames per tick within the session's range: newly prepared, kept and discarded against the tick before."""
    low = F.greatest(F.col("frame") - back, F.col("range_start"))
    high = F.least(F.col("frame") + ahead, F.col("range_end") - 1)
    none = F.array().cast("array<bigint>")
    window = F.when(low <= high, F.slice(F.sequence(low, high), 1, most)).otherwise(none)
    seen = ordered_scan(
        ticks.select("session_id", "seq", "frame", window.alias("window")), ["session_id"], ["seq"], div("seq", chunk_width),
        lags={"before": F.col("window")}).withColumn("before", F.coalesce("before", none))
    return seen.withColumns({
        "added": F.array_except("window", "before"), "kept": F.array_intersect("window", "before"),
        "discarded": F.array_except("before", "window")})


def window_health(windows: DataFrame, low_water: int) -> DataFrame:
    """Health of what was prepared before a tick, at the frame the tick plays."""
    left = F.size(F.filter("before", lambda f: f >= F.col("frame")))
    health = (
        F.when(F.size("before") == 0, "Empty").when(~F.array_contains("before", F.col("frame")), "Underrun")
        .when(left < low_water, "LowWater").otherwise("Ok"))
    return windows.select("session_id", "seq", health.alias("health"))


def run_cap(ticks: DataFrame, most: int, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Ticks of each session up to ``most`` of them and up to the first one at or past the session's range end."""
    placed = ordered_scan(
        ticks, ["session_id"], ["seq"], div("seq", chunk_width), rank="tick",
        sums={"past": (F.col("frame") >= F.col("range_end")).cast("bigint")})
    return placed.where((F.col("tick") <= most) & (F.col("past") == 0)).drop("past")
