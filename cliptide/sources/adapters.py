"""Views that give the driver tables the shapes the operators work on.

Positions along a clip, session or run come from ``ordered_scan``, so no view sends a whole key to
one task. Everything else is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import ROWS_PER_CHUNK, div, ordered_scan
from .tables import load

ORDERS_PER_CHUNK = 1 << 16
# Events of one user per chunk of time: a user with a third of 10^12 events a year has a million a minute.
SECONDS_PER_CHUNK = 60


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _time_chunk(ts: str) -> Column:
    since = F.expr(f"timestampdiff(second, timestamp_ntz'1970-01-01', {ts})")
    return div(since, SECONDS_PER_CHUNK)


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_scan(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], _time_chunk("ts"), rank="seq")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered_events(spark, sf_dir).withColumn("k", _k())
    return e.selectExpr(
        "user_id as session_id",
        "seq",
        "event_id as command_id",
        "ts",
        """case when k % 4 <> 0 then case (seq - 1) % 12 when 0 then 'LoadPreparedInput' when 1 then 'Prepare'
             when 2 then 'Cue' when 3 then 'Preroll' when 4 then 'Play' when 5 then 'Play' when 6 then 'Pause'
             when 7 then 'Seek' when 8 then 'Preroll' when 9 then 'Play' when 10 then 'Stop' else 'Unload' end
           else case k % 10 when 0 then 'Snapshot' when 2 then 'Play' when 4 then 'Seek' when 6 then 'Cue'
             else 'Pause' end end as command""",
        "10 + cast(floor(value) as bigint) % 100 as frame",
        "case when k % 3 = 0 then cast(k % 5 as bigint) end as frame_count",
        "case when k % 29 = 0 then cast(999999 as bigint) end as expected_generation",
    )


def packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").withColumn(
        "payload_len",
        F.expr("cast(l_quantity as bigint) * 3 + case when l_orderkey % 97 = 0 then 1 else 0 end"),
    )
    # lineitem has no unique key: every column takes part in the order, and full ties are equal rows.
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
    placed = ordered_scan(
        lines, ["l_suppkey"], order, div("l_orderkey", ORDERS_PER_CHUNK), rank="packet_no",
        sums={"file_end": F.col("payload_len") + 20},
    )
    return placed.selectExpr(
        "l_suppkey as clip_id",
        "cast(l_linenumber % 4 as int) as channel",
        """case when l_linenumber <= 4 then concat('pcm.', cast(l_linenumber % 4 as string))
             when l_linenumber = 5 then 'avc.1' when l_linenumber = 6 then 'part.body' else 'fill' end as essence_key""",
        "packet_no",
        "payload_len",
        "24 as bit_depth",
        "case l_returnflag when 'A' then 'I' when 'R' then 'P' else 'B' end as picture",
        "l_returnflag = 'A' and l_linestatus = 'F' as is_sync",
        "cast(1 as bigint) as duration",
        "cast(l_linenumber - 3 as bigint) as composition_offset",
        "file_end - payload_len - 20 as file_offset",
    )


def picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet(spark, sf_dir).selectExpr(
        "clip_id", "packet_no - 1 as decode_no", "(packet_no - 1) % 480 = 0 as idr",
        "picture <> 'B' or (packet_no - 1) % 480 = 0 as reference",
        "cast(floor((packet_no - 1) / 480) as bigint) as segment_true",
        "2 * ((packet_no - 1) % 480) + case when picture <> 'B' or (packet_no - 1) % 480 = 0 then 0 else 3 end as poc_true",
    ).withColumn("poc_lsb", F.col("poc_true") % 256)


def pcm_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").selectExpr(
        "label as track_id", "vec_id as block_no", "embedding as samples"
    )


def pcm_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pcm_block(spark, sf_dir)
    return blocks.select("track_id", "block_no", F.posexplode("samples").alias("pos", "x")).selectExpr(
        "track_id", "block_no", "pos", "cast(floor(cast(x as double) * 8388608) as int) as s24"
    )


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as clip_id",
        "o_custkey as project_id",
        "concat('media://local/source/', cast(o_orderkey as string)) as public_uri",
        """case o_orderpriority when '1-URGENT' then 50 when '2-HIGH' then 25 when '3-MEDIUM' then 30000
             when '4-NOT SPECIFIED' then 60000 else 24000 end as rate_num""",
        "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 1001 end as rate_den",
        "cast(floor(o_totalprice) as bigint) % 60 as duration_frames",
        "o_orderkey % 20 as range_start",
        "o_orderkey % 20 + o_custkey % 40 as range_end",
        "case o_orderstatus when 'O' then 'Original' when 'P' then 'ProxyIfAvailable' else 'Proxy' end as playback_input",
        "o_orderkey % 5 <> 0 as proxy_available",
        "48000 as sample_rate",
        "24 as bit_depth",
        "cast(o_custkey % 5 as int) as lane_count",
        """case when o_orderkey % 97 = 0 then '/srv/media/original.mxf'
             else concat('opaque-', cast(o_orderkey as string)) end as binding_ref""",
        "case when o_orderkey % 89 = 0 then 'ProxyAac' else 'Original' end as audio_authority",
        "case when o_custkey % 2 = 0 then 1920 else 1280 end as width",
        "case when o_custkey % 2 = 0 then 1080 else 720 end as height",
        "case when o_custkey % 3 = 0 then 10 else 8 end as video_depth",
        "case when o_custkey % 3 = 0 then '4:2:2' else '4:2:0' end as chroma",
    )


def ranged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with the range of the session's clip; a session without a clip has [10, 90)."""
    ranges = clip(spark, sf_dir).select(F.col("clip_id").alias("session_id"), F.col("range_start").cast("bigint").alias("a"), F.col("range_end").cast("bigint").alias("b"))
    return command_log(spark, sf_dir).join(ranges, "session_id", "left").withColumns({
        "range_start": F.coalesce("a", F.lit(10)), "range_end": F.coalesce("b", F.lit(90))}).drop("a", "b")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with the identity and binding facts of a prepared input; each kind of fault is planted in one of 37."""
    faulty = {"range_end": "case when clip_id % 37 = 8 then range_start else range_end end",
              "audio_authority": "case when clip_id % 37 = 9 then 'Unknown' else audio_authority end"}
    return clip(spark, sf_dir).withColumns({k: F.expr(v) for k, v in faulty.items()}).selectExpr(
        "*",
        "case when clip_id % 37 = 1 then ' ' else '1.0' end as contract_version",
        "case when clip_id % 37 = 5 then '/srv/media/source' else concat('source-', cast(clip_id as string)) end as source_id",
        "case when clip_id % 37 = 2 then 'http://workspace/db' else 'media://local/workspace' end as workspace_uri",
        "case when clip_id % 37 = 3 then concat('media://local', chr(92), 'original') when clip_id % 2 = 1 then null else concat('media://local/original/', cast(clip_id as string)) end as original_media_id",
        "case when clip_id % 37 = 4 then 'media://local/file:/proxy' when clip_id % 3 = 1 then null else concat('media://local/proxy/', cast(clip_id as string)) end as proxy_media_id",
        "clip_id % 37 = 6 as private_path_exposed",
        "case when clip_id % 37 = 7 then 'file:/srv/proxy.mp4' when clip_id % 7 = 3 then null else 'opaque-proxy' end as proxy_binding_ref",
        "clip_id % 7 <> 5 as proxy_bound",
    )


def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip(spark, sf_dir).where("proxy_available").selectExpr(
        "case when clip_id % 11 = 0 then clip_id + 100000000 else clip_id end as clip_id",
        "case when clip_id % 3 = 0 then rate_num * 2 else rate_num end as rate_num",
        "case when clip_id % 3 = 0 then rate_den * 2 else rate_den end as rate_den",
        "duration_frames + case when clip_id % 7 = 0 then 1 else 0 end as duration_frames",
        "case when clip_id % 10 = 1 then 0 when clip_id % 9 = 0 then width + 8 else width end as width",
        "height",
        "case when clip_id % 8 = 0 then 10 else video_depth end as video_depth",
        "case when clip_id % 6 = 0 then '4:4:4' else chroma end as chroma",
    )


def frame_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        (F.col("seq") - 1).alias("frame"),
        F.col("value").alias("lateness_ms"),
        (_k() % 25 == 0).alias("duplicated"),
    )


def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(
        "user_id as run_id", "event_type as stage", "event_id as frame", "value as ms"
    )


def resource_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    created = orders.selectExpr(
        "o_custkey as session_id", "o_orderkey as resource_id", "'create' as op", "o_orderkey * 2 as seq"
    )
    destroyed = orders.where("o_orderstatus <> 'P'").selectExpr(
        "case when o_orderkey % 13 = 0 then o_custkey + 1 else o_custkey end as session_id",
        "o_orderkey as resource_id", "'destroy' as op", "o_orderkey * 2 + 1 + 2 * (o_custkey % 40) as seq",
    )
    return created.unionByName(destroyed)


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").selectExpr(
        "conv_id as session_id", "case when role = 'assistant' then 'response' else 'request' end as kind",
        "role as opcode", "turn as seq", "cast(length(text) as bigint) as payload_len",
    )
    return ordered_scan(
        turns, ["session_id"], ["seq"], div("seq", ROWS_PER_CHUNK),
        sums={"request_id": F.when(F.col("opcode") == "assistant", 0).otherwise(1)},
    )


def capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey as capability_id", "p_brand as device", "p_type as profile",
        "case when p_partkey % 5 = 4 then 'H265' else 'H264' end as codec",
        "case when p_partkey % 3 = 0 then 10 else 8 end as bit_depth",
        "p_size * 100 as max_width", "p_size * 60 as max_height",
        "case when p_partkey % 2 = 0 then 'hardware' else 'software' end as backend",
        "p_partkey % 7 <> 0 as progressive", "p_partkey % 4 = 3 as interlaced",
        "case when p_partkey % 3 = 0 then '4:2:2' else '4:2:0' end as chroma",
        "case p_partkey % 4 when 0 then 'integrated' when 1 then 'discrete' else 'other' end as device_class",
        "p_partkey % 5 = 0 as preferred_vendor",
    )


def capability_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capability(spark, sf_dir).where("capability_id % 6 <> 5").select("capability_id", "bit_depth", "chroma")


def decoder_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as request_id",
        """case o_custkey % 7 when 0 then 'STANDARD' when 1 then 'ECONOMY' when 2 then 'MEDIUM' when 3 then 'PROMO'
             when 4 then 'SMALL' when 5 then 'LARGE' else 'UNKNOWN' end as profile""",
        "case when o_orderkey % 4 = 0 then 10 else 8 end as bit_depth",
        "case when o_orderkey % 4 = 0 then '4:2:2' else '4:2:0' end as chroma",
        "case when o_orderkey % 6 = 5 then 'H265' else 'H264' end as codec",
        "case when o_custkey % 8 = 3 then 'interlaced' else 'progressive' end as scan",
        "1000 + o_custkey % 45 * 100 as width",
        "600 + o_custkey % 45 * 60 as height",
    )


def metadata_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    return (
        load(spark, sf_dir, "region").selectExpr("concat('R', cast(r_regionkey as string)) as uid", "'Storage' as kind")
        .unionByName(load(spark, sf_dir, "nation").selectExpr(
            "concat('N', cast(n_nationkey as string)) as uid", "'Package' as kind"))
        .unionByName(customer.selectExpr(
            "case when c_custkey % 200 = 7 then null else concat('C', cast(c_custkey as string)) end as uid",
            "'Track' as kind"))
        .unionByName(customer.where("c_custkey % 250 = 3").selectExpr(
            "concat('C', cast(c_custkey as string)) as uid", "'Track' as kind"))
    )


def metadata_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").selectExpr(
        "concat('N', cast(n_nationkey as string)) as from_uid", "concat('R', cast(n_regionkey as string)) as to_uid"
    ).unionByName(load(spark, sf_dir, "customer").selectExpr(
        "concat('C', cast(c_custkey as string)) as from_uid",
        """concat('N', cast(case when c_custkey % 50 = 0 then c_nationkey + 100 else c_nationkey end as string))
             as to_uid"""))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("k", _k()).selectExpr(
        "user_id % 40 as subsystem", "k % 24 as level_rank", "k % 2 = 0 as dequeued", "k % 3 = 0 as submitted",
        "k % 5 = 0 as timed_out", "k % 7 as callbacks", "k % 11 = 0 as drained", "k % 13 = 0 as errored",
        "k % 17 = 0 as configured", "event_id",
    )


def open_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_type = 'error'").withColumn("k", _k()).selectExpr(
        "event_id", "user_id as clip_id",
        """case k % 8 when 0 then 'MalformedSample' when 1 then 'SampleNormalization' when 2 then 'H264'
             when 3 then 'MissingAvcConfig' when 4 then 'NoVideoSamples' when 5 then 'Io' when 6 then 'TooManySamples'
             else 'TimestampOverflow' end as error_kind""",
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("(conv_id + turn) % 23 <> 5").selectExpr(
        "conv_id as session_id", "turn as seq", "cast(floor(turn / 3) as bigint) as generation", "role as kind"
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """case when page_id % 17 = 0 then concat('file:', url) when page_id % 19 = 0 then '/srv/media/clip.mxf'
             else url end as uri""",
    )


VIEWS = {
    f.__name__: f
    for f in (
        command_log, ranged_log, packet, picture, pcm_block, pcm_sample, clip, prepared, proxy, frame_decision, stage_timing, resource_log,
        message_log, capability, capability_format, decoder_request, metadata_node, metadata_ref, evidence,
        open_error, transcript, identity,
    )
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)
