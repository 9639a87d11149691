"""Decode capability matching, device choice, sessions' resources and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage
from .scan import ROWS_PER_CHUNK, div, ordered_scan

PIXELS_PER_BUCKET = 256
CONFIG = ["codec", "scan", "profile", "bit_depth", "chroma"]


def by_scan(capabilities: DataFrame) -> DataFrame:
    """One row for each scan mode a capability has; one that has neither decodes nothing."""
    modes = F.array_compact(F.array(F.when(F.col("progressive"), "progressive"), F.when(F.col("interlaced"), "interlaced")))
    return capabilities.withColumn("scan", F.explode(modes))


def usable(capabilities: DataFrame, formats: DataFrame) -> DataFrame:
    """Capabilities with some output format of their own depth and chroma."""
    return capabilities.join(formats, ["capability_id", "bit_depth", "chroma"], "left_semi")


def reach(capabilities: DataFrame) -> DataFrame:
    """Greatest height each backend offers for every width, as disjoint width intervals.

    A request is satisfied when *some* capability is at least as wide and as high, so per configuration
    only the staircase of (width, greatest height at that width or more) matters. That is one row per
    distinct width, however many capabilities there are, and each request meets at most one of them.
    """
    tall = lambda b: F.max(F.when(F.col("backend") == b, F.col("max_height")))
    per_width = by_scan(capabilities).groupBy(*CONFIG, "max_width").agg(
        tall("hardware").alias("hw"), tall("software").alias("sw"))
    wider = Window.partitionBy(*CONFIG).orderBy(F.desc("max_width")).rowsBetween(Window.unboundedPreceding, 0)
    narrower = Window.partitionBy(*CONFIG).orderBy("max_width")
    return per_width.select(
        *CONFIG, "max_width", F.coalesce(F.lag("max_width").over(narrower), F.lit(0)).alias("above"),
        F.max("hw").over(wider).alias("hw_height"), F.max("sw").over(wider).alias("sw_height"))


def match_requests(requests: DataFrame, capabilities: DataFrame, formats: DataFrame) -> DataFrame:
    """Backend chosen for each request: hardware, else software, else unsupported.

    Joined on (configuration, width bucket); the staircase is small, so Spark broadcasts it when its
    measured size allows and otherwise splits skewed request partitions.
    """
    steps = reach(usable(capabilities, formats)).withColumn(
        "bucket", F.explode(F.sequence(div(F.col("above") + 1, PIXELS_PER_BUCKET), div("max_width", PIXELS_PER_BUCKET))))
    asked = requests.withColumn("bucket", div("width", PIXELS_PER_BUCKET))
    fits = (F.col("width") > F.col("above")) & (F.col("width") <= F.col("max_width"))
    both = asked.alias("r").join(
        steps.alias("s"), [F.col(f"r.{k}") == F.col(f"s.{k}") for k in (*CONFIG, "bucket")] + [fits], "left")
    ok = lambda h: F.coalesce(F.col("height") <= F.col(h), F.lit(False))
    return both.select("request_id", ok("hw_height").alias("hardware"), ok("sw_height").alias("software")).withColumn(
        "backend", F.when(F.col("hardware"), "hardware").when(F.col("software"), "software").otherwise("unsupported"))


def preferred_device(devices: DataFrame, group: str, allow_discrete: bool = True) -> DataFrame:
    """One device per group: integrated of the preferred vendor, integrated, then discrete; or an error row."""
    rank = (
        F.when(F.col("preferred_vendor") & (F.col("device_class") == "integrated"), 0)
        .when(F.col("device_class") == "integrated", 1)
        .when(F.lit(allow_discrete) & (F.col("device_class") == "discrete"), 2)
    )
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "capability_id")))
    return devices.groupBy(group).agg(best.alias("best")).select(
        group, F.col("best.capability_id").alias("capability_id"),
        F.when(F.col("best").isNull(), "no device advertised").otherwise("ok").alias("status"))


def replies(messages: DataFrame) -> DataFrame:
    """Each request with its responses; zero responses means unanswered."""
    answers = messages.where("kind = 'response'").groupBy("session_id", "request_id").agg(
        F.count("*").alias("responses"), F.min("seq").alias("first_response"))
    asked = messages.where("kind = 'request'").select("session_id", "request_id", "opcode", "seq")
    return asked.join(answers, ["session_id", "request_id"], "left").fillna(0, ["responses"])


def reply_summary(messages: DataFrame, is_error: Column) -> DataFrame:
    """Unanswered requests and the share of error responses per opcode of the request."""
    errors = messages.where("kind = 'response'").groupBy("session_id", "request_id").agg(
        F.count("*").alias("n"), F.count_if(is_error).alias("bad"))
    asked = messages.where("kind = 'request'").select("session_id", "request_id", "opcode")
    return asked.join(errors, ["session_id", "request_id"], "left").groupBy("opcode").agg(
        F.count("*").alias("requests"), F.count_if(F.col("n").isNull()).alias("unanswered"),
        F.round(F.try_divide(F.sum("bad"), F.sum("n")), 6).alias("error_share"))


def live_at_disconnect(log: DataFrame) -> DataFrame:
    """Resources each session created and did not destroy itself."""
    own = log.groupBy("session_id", "resource_id").agg(
        F.sum(F.when(F.col("op") == "create", 1).otherwise(0)).alias("made"),
        F.sum(F.when(F.col("op") == "destroy", 1).otherwise(0)).alias("gone"))
    return own.groupBy("session_id").agg(
        F.count_if(F.col("made") > F.col("gone")).alias("live")).where("live > 0")


def ownership_audit(log: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Outcome of every operation on a resource; failing ones have no effect on later ones.

    A resource's life ends with its owner's first destroy: a second destroy and any other use after it fail alike.
    """
    created = F.col("op") == "create"
    # Staged between the scans: each reads its input twice.
    owned = stage(ordered_scan(
        log, ["resource_id"], ["seq", "op", "session_id"], div("seq", chunk_width),
        sums={"life": created.cast("bigint")}, lasts={"owner": F.when(created, F.col("session_id"))}), "owned")
    ends = (F.col("op") == "destroy") & (F.col("session_id") == F.col("owner"))
    ended = ordered_scan(
        owned, ["resource_id", "life"], ["seq", "op", "session_id"], div("seq", chunk_width),
        sums={"ends": F.coalesce(ends, F.lit(False)).cast("bigint")})
    outcome = (
        F.when(created, "ok").when(F.col("owner").isNull(), "unknown-resource")
        .when(F.col("session_id") != F.col("owner"), "not-owner")
        .when(F.col("ends") > F.when(F.col("op") == "destroy", 1).otherwise(0), "already-destroyed").otherwise("ok")
    )
    return ended.select("session_id", "resource_id", "op", "seq", outcome.alias("outcome"))


# Evidence levels from weakest to strongest, one rank each.
EVIDENCE_LEVELS = (
    "NotImplemented", "CompileChecked", "UnitTested", "MediaInspected", "PayloadExtracted", "PayloadBound",
    "TestBoundaryEvidence", "FilePresenterManifestWritten", "FilePresenterImageWritten",
    "NativeBufferSubmissionVerified", "NativePostSubmitEvidence", "RuntimeAudioPayloadDrainCompleted",
    "RuntimeAudioPayloadAudibleConfirmed", "ControlSurfaceEvidence", "SelectionPolicyEvidence",
    "OperationalStateEvidence", "FaultRecoveryPolicyEvidence", "RuntimeBehaviorEvidence", "AssemblySurfaceEvidence",
    "ArchitectureAuditEvidence", "ContractPlanEvidence", "DescriptorMappingEvidence", "ControlSurfaceShapeEvidence",
    "LiveRuntimeLoopEvidence", "LiveControlInputEvidence", "LiveDiagnosticOutputEvidence",
)


def evidence_rollup(facts: DataFrame) -> DataFrame:
    """Highest level reached per subsystem, with its name; rank 0 is the not-implemented list."""
    names = F.array(*map(F.lit, EVIDENCE_LEVELS))
    top = facts.groupBy("subsystem").agg(F.max("level_rank").alias("level_rank"), F.count("*").alias("facts"))
    name = F.coalesce(F.get(names, F.col("level_rank").cast("int")), F.concat(F.lit("level-"), F.col("level_rank").cast("string")))
    return top.select("subsystem", "level_rank", "facts", name.alias("level"), (F.col("level_rank") == 0).alias("not_implemented"))
