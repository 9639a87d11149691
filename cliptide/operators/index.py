"""Packet indexes of a clip: classification, positions, ranges, gaps and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import frame_samples
from .interval import covered_measure, interval_join
from ..sources.sinks import store_clustered
from ..sources.tables import stage
from .scan import ROWS_PER_CHUNK, div, ordered_scan

# Samples per bucket of an interval join: about one packet of a 48 kHz clip at 25 frames per second.
SAMPLES_PER_BUCKET = 2048
# Samples per chunk of a gap audit: about 23 minutes at 48 kHz, some tens of thousands of packets.
SAMPLES_PER_CHUNK = 1 << 26


def essence_kind(key: Column) -> Column:
    """What a packet carries, from its key."""
    return (
        F.when(key.startswith("pcm."), "pcm")
        .when(key.startswith("avc."), "video")
        .when(key.startswith("part."), "partition")
        .when(key.startswith("index."), "index")
        .when(key.startswith("set."), "metadata")
        .when(key == "fill", "filler")
        .otherwise("other")
    )


def pcm_channel(key: Column, max_channels: int = 64) -> Column:
    """Channel of a PCM key, null for other keys and for channels past the limit, which ``limit_audit`` reports."""
    n = channel_number(key)
    return F.when(n < max_channels, n.cast("int"))


def channel_number(key: Column) -> Column:
    """Number in a PCM key whatever its size; null for other keys and for what is no number."""
    return F.when(key.startswith("pcm."), F.substr(key, F.lit(5)).try_cast("bigint"))


def track_kind(handler: Column) -> Column:
    """Track kind from its handler code."""
    return (
        F.when(handler == "vide", "video")
        .when(handler == "soun", "audio")
        .when(handler.isin("meta", "mdir", "mdta"), "data")
        .otherwise("other")
    )


def sample_count(payload_len: Column, bit_depth: Column, channels: Column) -> Column:
    """Samples in a PCM payload; null when depth, channels or the remainder make it invalid."""
    width = div(bit_depth, 8).cast("bigint") * channels
    ok = (bit_depth > 0) & (bit_depth % 8 == 0) & (channels > 0)
    return F.when(ok, F.when(payload_len % width == 0, div(payload_len, width)))


def extent_ok(offset: Column, length: Column, file_len: Column) -> Column:
    return (offset < file_len) & (offset + length <= file_len)


def random_access(slices: Column) -> Column:
    """A picture is a random access point when any slice is intra coded."""
    return F.exists(slices, lambda s: s.isin("IDR", "I"))


def packet_index(packets: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Audio index: edit unit and start sample of every valid PCM packet per clip and channel."""
    pcm = packets.where(F.col("essence_key").startswith("pcm.")).withColumn(
        "sample_count", sample_count(F.col("payload_len"), F.col("bit_depth"), F.lit(1))
    ).where("sample_count is not null").select(
        "clip_id", "channel", "packet_no", "sample_count", "file_offset", "payload_len")
    placed = ordered_scan(
        pcm, ["clip_id", "channel"], ["packet_no"], div("packet_no", chunk_width),
        rank="_n", sums={"end_sample": F.col("sample_count")},
    )
    return placed.select(
        "clip_id", "channel", "packet_no", (F.col("_n") - 1).alias("edit_unit"),
        (F.col("end_sample") - F.col("sample_count")).alias("start_sample"), "sample_count", "end_sample",
        "file_offset", "payload_len",
    )


def tracks_by_rank(index: DataFrame, tracks: DataFrame) -> DataFrame:
    """Give each channel its track: channel n is the n-th audio track by id; others are skipped.

    A clip has at most 64 tracks, so ranking within a clip stays small; the tracks are counted before
    the rows they are joined to.
    """
    ids = tracks.groupBy("clip_id").agg(F.sort_array(F.collect_set("track_id")).alias("ids"))
    ranked = ids.select("clip_id", F.posexplode("ids").alias("channel", "track_id"))
    return index.join(ranked, ["clip_id", "channel"])


def index_only(packets: DataFrame) -> DataFrame:
    """Packet descriptors without payload: only these columns reach the scan."""
    return packets.select("clip_id", "packet_no", "essence_key", "file_offset", "payload_len")


#: Order of a stored index: a clip's channel lies together, by sample.
CLUSTERED_BY = ("clip_id", "channel", "start_sample")


def stored_index(index: DataFrame, path: str, rows_per_group: int = ROWS_PER_CHUNK) -> DataFrame:
    """Write an index clustered by clip, channel and sample, and read it back.

    Files hold ranges of this order and row groups of about ``rows_per_group`` rows carry least and greatest values, so a
    range of samples, or of clips, reads the groups that it meets and no others.
    """
    return store_clustered(index, path, CLUSTERED_BY, rows_per_group)


def extract_range(index: DataFrame, start: int, end: int) -> DataFrame:
    """Packets overlapping ``[start, end)``; a plain filter, which the scan of a stored index gets."""
    return index.where((F.col("end_sample") > start) & (F.col("start_sample") < end))


def requests_on_index(requests: DataFrame, index: DataFrame, width: int = SAMPLES_PER_BUCKET) -> DataFrame:
    """Requested ``[req_start, req_end)`` against index entries of the same clip."""
    return interval_join(requests, index, ["clip_id"], ("req_start", "req_end"), ("start_sample", "end_sample"), width)


def gap_audit(index: DataFrame, chunk_width: int = SAMPLES_PER_CHUNK) -> DataFrame:
    """Start of each block against the end of the one before it: ok, gap or overlap."""
    seen = ordered_scan(
        index, ["clip_id", "channel"], ["start_sample", "edit_unit", "copy"], div("start_sample", chunk_width),
        lags={"prev_end": F.col("end_sample")},
    )
    delta = F.col("start_sample") - F.col("prev_end")
    status = F.when(delta > 0, "gap").when(delta < 0, "overlap").otherwise("ok")
    return seen.withColumns({"delta": F.coalesce(delta, F.lit(0)), "status": status})


def gap_totals(audit: DataFrame) -> DataFrame:
    """Counts and samples per clip and channel, with the monotonic flag."""
    return audit.groupBy("clip_id", "channel").agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("status") == "gap").alias("gap_blocks"),
        F.count_if(F.col("status") == "overlap").alias("overlap_blocks"),
        F.sum(F.greatest("delta", F.lit(0))).alias("gap_samples"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("overlap_samples"),
        F.bool_and(F.col("delta") >= 0).alias("monotonic"),
    )


def clip_samples(index: DataFrame) -> DataFrame:
    """Samples every channel of a clip can deliver: least over channels of the greatest end."""
    per_channel = index.groupBy("clip_id", "channel").agg(F.max("end_sample").alias("end_sample"))
    return per_channel.groupBy("clip_id").agg(
        F.min("end_sample").alias("total_samples"), F.count("*").alias("channels"))


def picture_counts(packets: DataFrame) -> DataFrame:
    """Pictures by kind and sync pictures per clip."""
    kinds = [F.count_if(F.col("picture") == k).alias(f"n_{k.lower()}") for k in ("I", "P", "B")]
    return packets.groupBy("clip_id").agg(*kinds, F.count_if("is_sync").alias("n_sync"))


def idr_positions(packets: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Positions of sync pictures in order, one row each: a long clip never becomes one array."""
    sync = packets.where("is_sync").select("clip_id", (F.col("packet_no") - 1).alias("position"))
    return ordered_scan(sync, ["clip_id"], ["position"], div("position", chunk_width), rank="idr_no")


def gop_summary(packets: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Groups that start at each sync picture; group 0 is what precedes the first."""
    runs = ordered_scan(
        packets.select("clip_id", "packet_no", "payload_len", "is_sync"), ["clip_id"], ["packet_no"],
        div("packet_no", chunk_width), sums={"gop_no": F.col("is_sync").cast("bigint")},
    )
    return runs.groupBy("clip_id", "gop_no").agg(
        F.count("*").alias("length"), F.sum("payload_len").alias("bytes"),
        F.min("packet_no").alias("first_packet"), F.max("packet_no").alias("last_packet"),
    )


def override_index(derived: DataFrame, provided: DataFrame) -> DataFrame:
    """Overlay provided entries on derived ones, only for clips where the two counts match."""
    agree = (
        derived.groupBy("clip_id").agg(F.count("*").alias("n"))
        .join(provided.groupBy("clip_id").agg(F.count("*").alias("n")), ["clip_id", "n"])
        .select("clip_id", F.lit(True).alias("_agree"))
    )
    both = derived.join(agree, "clip_id", "left").join(provided, ["clip_id", "edit_unit"], "left")
    taken = F.coalesce("_agree", F.lit(False)) & F.col("key_frame_offset").isNotNull()
    return both.select(
        "clip_id", "edit_unit",
        F.when(taken, "provided").otherwise("derived").alias("source"),
        F.when(taken, F.col("key_frame_offset") == 0).otherwise(F.col("random_access")).alias("random_access"),
    )


def _channels(index: DataFrame) -> DataFrame:
    """The channels of each clip: 64 at most, so they stay a short list."""
    return stage(index.groupBy("clip_id").agg(F.collect_set("channel").alias("channels")), "channels")


def frame_coverage(frames: DataFrame, index: DataFrame, tracks: int, chunk_width: int = SAMPLES_PER_CHUNK) -> DataFrame:
    """How many tracks cover some of each frame's sample range, the samples covered, and whether all tracks do so fully.

    A sample that several blocks of a track hold counts once; a frame with a hole in any track is not complete.
    """
    return _coverage(frames.join(_channels(index), "clip_id", "left"), index, tracks, chunk_width)


def clip_frame_coverage(clips: DataFrame, index: DataFrame, tracks: int, chunk_width: int = SAMPLES_PER_CHUNK) -> DataFrame:
    """``frame_coverage`` of all frames of clips. Clips meet their channels before their frames are opened, so frames of
    clips without audio are never shuffled."""
    needed = clips.select("clip_id", "duration_frames", "sample_rate", "rate_num", "rate_den")
    return _coverage(frame_samples(needed.join(_channels(index), "clip_id", "left")), index, tracks, chunk_width)


def _coverage(frames: DataFrame, index: DataFrame, tracks: int, chunk_width: int) -> DataFrame:
    """Coverage of frames that know their clip's channels; null where the index has none."""
    asked = frames.select("clip_id", "frame", F.col("start_sample").alias("f_start"), F.col("end_sample").alias("f_end"), "channels")
    none = F.lit(0).cast("bigint")
    silent = asked.where("channels is null").select("clip_id", "frame", none.alias("tracks"), none.alias("covered"), F.lit(False).alias("complete"))
    entries = index.select("clip_id", "channel", "start_sample", "end_sample")
    per_track = stage(asked.where("channels is not null").withColumn("channel", F.explode("channels")).drop("channels"), "asked")
    # A frame that comes twice in a clip is one frame in what its tracks cover, and two rows.
    found = covered_measure(
        per_track, entries, ["clip_id", "channel"], ("f_start", "f_end"), ("start_sample", "end_sample"), "got", chunk_width
    ).groupBy("clip_id", "frame", "channel").agg(
        F.sum("got").alias("got"), F.max(F.col("f_end") - F.col("f_start")).alias("length"), F.count("*").alias("rows")
    ).groupBy("clip_id", "frame").agg(
        F.count_if(F.col("got") > 0).alias("tracks"), F.sum("got").alias("covered"),
        F.count_if((F.col("got") > 0) & (F.col("got") == F.col("length"))).alias("whole"), F.max("rows").alias("rows"))
    full = (F.col("tracks") == tracks) & (F.col("whole") == tracks)
    heard = found.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).select(
        "clip_id", "frame", "tracks", "covered", full.alias("complete"))
    return silent.unionByName(heard)


def limit_audit(packets: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Clips and channels past a cap, in long form (limit, clip, channel, value)."""
    per_channel = packets.groupBy("clip_id", "channel").agg(
        F.count("*").alias("n"), F.max("payload_len").alias("largest"), F.max(channel_number(F.col("essence_key"))).alias("number"))
    per_clip = per_channel.groupBy("clip_id").agg(
        F.sum("n").alias("packets"), F.count("*").alias("channels"), F.max("largest").alias("largest"), F.max("number").alias("number"))
    parts = [
        per_channel.select(F.lit("entries_per_channel").alias("cap"), "clip_id", "channel", F.col("n").alias("value")),
        *(
            per_clip.select(F.lit(cap).alias("cap"), "clip_id", F.lit(-1).alias("channel"), F.col(c).alias("value"))
            for cap, c in (("packets_per_clip", "packets"), ("channels_per_clip", "channels"),
                           ("payload_bytes", "largest"), ("channel_number", "number"))
        ),
    ]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    cap_of = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return long.withColumn("allowed", cap_of[F.col("cap")].cast("bigint")).where("value > allowed")


def corpus_summary(index: DataFrame, sample_rate: int = 48000) -> DataFrame:
    """Tracks, packets, bytes and seconds per track, per clip and overall."""
    per_track = index.groupBy("clip_id", "channel").agg(
        F.count("*").alias("n"), F.sum("payload_len").alias("b"), F.sum("sample_count").alias("s"))
    return per_track.rollup("clip_id", "channel").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("tracks"), F.sum("n").alias("packets"),
        F.sum("b").alias("bytes"), F.round(F.sum("s") / sample_rate, 6).alias("seconds"))


def derived_rate(packets: DataFrame, timescale: int) -> DataFrame:
    """Frame rate of a clip from its packet durations; 0/1 when nothing has a duration."""
    total = packets.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("duration").alias("units"))
    some = F.col("units") > 0
    return total.select(
        "clip_id", F.when(some, F.col("n") * timescale).otherwise(0).alias("rate_num"),
        F.when(some, F.col("units")).otherwise(1).alias("rate_den"))


def presentation_times(packets: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Decode time as the running duration, and presentation time as decode time plus offset."""
    timed = ordered_scan(
        packets.select("clip_id", "packet_no", "duration", "composition_offset"), ["clip_id"], ["packet_no"],
        div("packet_no", chunk_width), sums={"_end": F.col("duration")},
    ).withColumn("dts", F.col("_end") - F.col("duration"))
    return timed.select("clip_id", "packet_no", "dts", (F.col("dts") + F.col("composition_offset")).alias("pts"))


def av_extent(clips: DataFrame, index: DataFrame, every: int = 2) -> DataFrame:
    """Audio length minus video length per clip, and the number of its selected frames that reach past the audio.

    A frame's end does not fall from one frame to the next, so the frames past the audio are those from a first one on, which is
    reckoned from the rate: a clip costs one row whatever its length. What the index tells is staged, so that Spark
    compares its measured size with the clips', and not a guess.
    """
    audio = stage(clip_samples(index).select("clip_id", "total_samples"), "extents")
    frames, num = F.col("duration_frames").cast("bigint"), F.col("rate_num").cast("bigint")
    per = F.col("sample_rate").cast("bigint") * F.col("rate_den")
    # The end of frame f - 1 is floor(f * per / num): past the audio from f = ceil((total + 1) * num / per) on.
    beyond = F.col("total_samples") + 1
    first = div(beyond, per) * num + div(beyond % per * num + per - 1, per) - 1
    up_to = lambda x: div(x + every - 1, every)
    past = F.when((frames > 0) & (num > 0) & (per > 0), up_to(frames) - up_to(F.least(F.greatest(first, F.lit(0)), frames))).otherwise(0)
    seconds = F.col("total_samples") / F.col("sample_rate") - F.col("duration_frames") * F.col("rate_den") / F.col("rate_num")
    # Whole microseconds are rounded, as the SQL does: rounding the decimal digits of seconds differs where a half is not exact.
    delta = F.round(seconds * 1_000_000) / 1_000_000
    # A clip id that comes twice is one clip of all its frames.
    outside = F.sum(past).over(Window.partitionBy("clip_id"))
    return clips.join(audio, "clip_id").select("clip_id", delta.alias("delta_seconds"), outside.alias("outside_frames"))


def cut_summary(cuts: DataFrame, every: int) -> DataFrame:
    """Preview frames, source frames, skips and seconds of each cut on the decimated timeline.

    Counted from the cut's ends, so a cut costs one row whatever its length.
    """
    up_to = lambda c: div(F.col(c).cast("bigint") + every - 1, every)
    source = F.greatest(F.col("cut_out") - F.col("cut_in"), F.lit(0)).cast("bigint")
    return cuts.withColumn("source_frames", source).withColumn(
        "preview_frames", F.when(F.col("source_frames") > 0, up_to("cut_out") - up_to("cut_in")).otherwise(0)
    ).select(
        "clip_id", "source_frames", "preview_frames", (F.col("source_frames") - F.col("preview_frames")).alias("skipped"),
        F.round(F.col("source_frames") * F.col("rate_den") / F.col("rate_num"), 6).alias("seconds"))


def format_homogeneity(clips: DataFrame, group: str) -> DataFrame:
    """One sample rate, depth and layout per group, else "mixed"; min = max needs no distinct."""
    fields = ("sample_rate", "bit_depth", "lane_count", "video_depth")
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c).cast("string")).otherwise("mixed")
    return clips.groupBy(group).agg(*[same(c).alias(c) for c in fields], F.count("*").alias("clips"))
