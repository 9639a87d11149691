"""Row rules: validation, classification and projection as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Failure kind of an open error -> health class.
HEALTH = {
    "SampleNormalization": "DamagedUnrecoverable",
    "MalformedSample": "DamagedUnrecoverable",
    "H264": "DamagedUnrecoverable",
    "MissingAvcConfig": "ValidButUnsupported",
    "InvalidNalLengthSize": "ValidButUnsupported",
    "NoVideoSamples": "ValidButUnsupported",
    "Io": "FatalContainerError",
    "Parse": "FatalContainerError",
    "FileTooLarge": "FatalContainerError",
    "TooManyTracks": "FatalContainerError",
    "TooManySamples": "FatalContainerError",
    "SampleTooLarge": "FatalContainerError",
    "MissingTrack": "FatalContainerError",
    "MissingSample": "FatalContainerError",
    "InvalidRational": "FatalContainerError",
    "TimestampOverflow": "FatalContainerError",
}

# Outcome labels of the prepared-input rules.
URI_MISSING = "missing public source URI"
PATH_EXPOSED = "private path exposure rejected"
PROXY_AUDIO = "proxy AAC cannot be authoritative"
AUDIO_MISSING = "missing authoritative original audio"
PICTURE_MISMATCH = "selected picture representation does not match source mode"
INPUT_MISMATCH = "playback input does not match source mode and selected picture"
NO_LANES = "no original audio lanes"
STEREO = "stereo collapse is not a valid runtime audio model"
PROJECT_AUDIO = "invalid project audio"
RANGE = "invalid active range"
TIMING_UNKNOWN = "original/proxy timing compatibility unknown"
MODE = "invalid source mode"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """A fixed small mapping as a literal map; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def first_label(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Label of the first rule that holds; null conditions do not hold."""
    return F.coalesce(*[F.when(cond, label) for cond, label in rules], F.lit(otherwise))


def in_range(frame: Column, start: Column, end: Column) -> Column:
    return (start < end) & (frame >= start) & (frame < end)


def range_ok(start: Column, end: Column, duration: Column) -> Column:
    return (start < end) & (end <= duration)


def step_frame(frame: Column, delta: Column, start: Column, end: Column) -> Column:
    """Step by ``delta`` and stay inside ``[start, end)``; an empty range holds at its start."""
    return F.least(F.greatest(frame + delta, start), F.greatest(end - 1, start))


def decimation(frame: Column, every: int) -> Column:
    return F.when(frame % every == 0, "selected").otherwise("intentional-skip")


def tick_label(tick: Column, every: int) -> Column:
    return F.when(tick % max(every, 1) == 0, "emit").otherwise("skipped")


def presentation(lateness_ms: Column, on_time_ms: float = 5, drop_ms: float = 40) -> Column:
    return F.when(lateness_ms <= on_time_ms, "OnTime").when(lateness_ms <= drop_ms, "Late").otherwise("Dropped")


def health_class(error_kind: Column) -> Column:
    """Health class of a clip that failed to open; clips that open are Valid."""
    return F.when(error_kind.isNull(), "Valid").otherwise(F.coalesce(lookup(HEALTH, error_kind), F.lit("FatalContainerError")))


def submission_evidence(
    errored: Column, drained: Column, callbacks: Column, timed_out: Column, submitted: Column, dequeued: Column,
    configured: Column,
) -> Column:
    """Strongest thing known of a submitted buffer; errors hide everything else."""
    return first_label(
        [
            (errored, "StreamErrorAfterSubmit"),
            (drained, "DrainCompleted"),
            (callbacks > 0, "PostSubmitCallbackObserved"),
            (timed_out, "PostSubmitTimeout"),
            (submitted, "BufferSubmitted"),
            (dequeued, "BufferDequeued"),
            (configured, "NativeStreamConfigured"),
        ],
        "NativeStreamCreated",
    )


def picture_choice(requested: Column, proxy_available: Column) -> Column:
    """Picture for the requested input: Original, Proxy or MissingProxy."""
    return (
        F.when(requested == "Original", "Original")
        .when(proxy_available, "Proxy")
        .when(requested == "ProxyIfAvailable", "Original")
        .otherwise("MissingProxy")
    )


def source_mode(picture: Column) -> Column:
    return F.when(picture == "Proxy", "ProxyPreview").when(picture == "Original", "OriginalMedia").otherwise("MissingProxy")


def input_agrees(requested: Column, proxy_available: Column, mode: Column, picture: Column) -> Column:
    """The requested input, proxy availability, mode and picture say the same thing."""
    original = (mode == "OriginalMedia") & (picture == "Original")
    proxy = (mode == "ProxyPreview") & (picture == "Proxy")
    return (
        F.when(requested == "Original", original)
        .when(requested == "Proxy", proxy_available & proxy)
        .when(proxy_available, proxy)
        .otherwise(original)
    )


def lane_label(lane: Column) -> Column:
    return F.concat(F.lit("A"), (lane + 1).cast("string"))


def lanes(channels: Column) -> Column:
    """Channel list to lanes: numbered in order, mono and authoritative."""
    return F.transform(
        channels,
        lambda x, i: F.struct(
            i.alias("lane_index"), x.alias("source_channel"), F.lit("Mono").alias("kind"), F.lit(True).alias("authoritative")),
    )


def lanes_ok(lane_list: Column) -> Column:
    """Every lane is mono, authoritative and numbered by its place."""
    checked = F.transform(
        lane_list, lambda x, i: (x["kind"] == "Mono") & x["authoritative"] & (x["lane_index"] == i))
    return F.forall(checked, lambda ok: ok)


def public_uri_ok(uri: Column, scheme: str = "media://") -> Column:
    return uri.startswith(scheme) & ~uri.contains("\\") & ~uri.contains("file:")


def exposes_path(text: Column) -> Column:
    return text.startswith("/") | text.contains("file:")


# The texts of a prepared input in which a private path may show.
PRIVATE_FIELDS = (
    "binding_ref", "proxy_binding_ref", "public_uri", "source_id", "workspace_uri", "original_media_id", "proxy_media_id",
)


def exposes_any(fields: Sequence[str] = PRIVATE_FIELDS, flag: str = "private_path_exposed") -> Column:
    """A record is private if it says so itself or if any of its texts shows a path; never null."""
    shown = [F.coalesce(exposes_path(F.col(f)), F.lit(False)) for f in fields]
    return any_of([F.coalesce(F.col(flag), F.lit(False)), *shown])


def path_audit(df: DataFrame, key: str, fields: Sequence[str] = PRIVATE_FIELDS, flag: str = "private_path_exposed") -> DataFrame:
    """Long form of every field that shows a private path, and of the flag where it is set."""
    long = df.unpivot([key], list(fields), "field", "text").where(exposes_path(F.col("text"))).select(key, "field")
    return long.unionByName(df.where(flag).select(key, F.lit(flag).alias("field")))


def path_counts(df: DataFrame, fields: Sequence[str] = PRIVATE_FIELDS) -> DataFrame:
    """Per field: values that show a private path, and values that are there."""
    # All fields in one pass over the rows; only the one row of counters is turned.
    counters = [x for f in fields for x in (F.count_if(exposes_path(F.col(f))).alias(f"blocked_{f}"), F.count(f).alias(f"checked_{f}"))]
    per_field = [F.struct(F.lit(f).alias("field"), F.col(f"blocked_{f}").alias("blocked"), F.col(f"checked_{f}").alias("checked")) for f in fields]
    return df.agg(*counters).select(F.explode(F.array(*per_field)).alias("x")).select("x.*")


def validate_prepared(scheme: str = "media://") -> Column:
    """First failing rule of a prepared input, or ``ok``.

    Expects contract_version, the texts of PRIVATE_FIELDS, private_path_exposed, audio_authority,
    proxy_aac_authoritative, playback_input, proxy_available, picture, mode, lanes, sample_rate, bit_depth,
    project_channels, project_rate, rate_den, duration_frames, range_start, range_end, timing_compatible, proxy_bound
    and proxy_video. The media ids may be null, the other two URIs may not; a null range is no range.
    """
    c = F.col
    by_proxy = c("mode") == "ProxyPreview"
    known = lambda name: F.coalesce(c(name), F.lit(False))
    compatible = known("timing_compatible")
    public = lambda name, absent: F.coalesce(public_uri_ok(c(name), scheme), F.lit(absent))
    named = (
        (F.trim(F.coalesce("contract_version", F.lit(""))) != "") & public("public_uri", False) & public("workspace_uri", False)
        & public("original_media_id", True) & public("proxy_media_id", True)
    )
    return first_label(
        [
            (~named, URI_MISSING),
            (exposes_any(), PATH_EXPOSED),
            (c("proxy_aac_authoritative"), PROXY_AUDIO),
            (c("audio_authority") != "Original", AUDIO_MISSING),
            (~(((c("mode") == "ProxyPreview") & (c("picture") == "Proxy"))
               | ((c("mode") == "OriginalMedia") & (c("picture") == "Original"))), PICTURE_MISMATCH),
            (~input_agrees(c("playback_input"), c("proxy_available"), c("mode"), c("picture")), INPUT_MISMATCH),
            (F.size("lanes") == 0, NO_LANES),
            (~lanes_ok(c("lanes")), STEREO),
            ((c("sample_rate") == 0) | (c("bit_depth") == 0) | (c("project_channels") == 0)
             | (c("project_rate") == 0) | (c("project_rate") != c("sample_rate"))
             | (c("project_channels") > F.size("lanes")) | (c("rate_den") == 0) | (c("duration_frames") == 0),
             PROJECT_AUDIO),
            (c("range_start") >= c("range_end"), RANGE),
            (by_proxy & ~compatible, TIMING_UNKNOWN),
            (by_proxy & (~known("proxy_bound") | c("proxy_binding_ref").isNull() | ~known("proxy_video")), MODE),
        ],
        "ok",
    )


def preroll_status(video: Column, audio: Column, need_video: int, need_audio: int, limits_ok: Column) -> Column:
    """Ready, or the part that keeps the preroll from being ready."""
    return first_label(
        [
            (~limits_ok, "invalid queue limits"),
            ((video < need_video) & (audio < need_audio), "video and audio missing"),
            (video < need_video, "video missing"),
            (audio < need_audio, "audio missing"),
        ],
        "ready",
    )


def descriptor_mismatch(df: DataFrame, key: str) -> DataFrame:
    """Metadata against essence for width, height, depth and chroma, one row per disagreement.

    A zero in the metadata means unknown for the numeric fields.
    """
    checks = [
        F.struct(F.lit(f).alias("field"), F.col(f"meta_{f}").cast("string").alias("metadata"),
                 F.col(f"real_{f}").cast("string").alias("essence"), F.lit(numeric).alias("numeric"))
        for f, numeric in (("width", True), ("height", True), ("video_depth", True), ("chroma", False))
    ]
    long = df.select(key, F.explode(F.array(*checks)).alias("d")).select(key, "d.*")
    return long.where(
        (F.col("metadata") != F.col("essence")) & ~(F.col("numeric") & (F.col("metadata") == "0"))
    ).drop("numeric")
