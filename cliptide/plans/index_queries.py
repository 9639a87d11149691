"""Sources, packet predicates, index windows, index joins and index aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators.interval import asof_backward
from ..operators.scan import ROWS_PER_CHUNK, div, ordered_scan
from ..sources import stage
from ..sources.tables import fresh_path
from .registry import query
from .snippets import DAMAGED, INDEX, OVERLAPPING, REQUESTS, damaged, overlapping, requests

c = F.col

GAPS = DAMAGED + """, seen as (select *, lag(end_sample) over (partition by clip_id, channel
    order by start_sample, edit_unit, copy) as prev_end from damaged),
audit as (select clip_id, channel, edit_unit, copy, coalesce(start_sample - prev_end, 0) as delta,
  case when start_sample > prev_end then 'gap' when start_sample < prev_end then 'overlap' else 'ok' end as status
  from seen)"""
TOTALS = """, totals as (select clip_id, min(e) as total_samples, count(*) as channels from
  (select clip_id, channel, max(end_sample) as e from idx group by all) m group by clip_id)"""


@query("flagship_audio_seconds", ["packet"], GAPS + TOTALS + """
, g as (select clip_id, count(*) as blocks, count(*) filter (status = 'gap') as gap_blocks,
    count(*) filter (status = 'overlap') as overlap_blocks from audit group by clip_id)
select clip_id, total_samples, channels, round(total_samples / 48000.0::double, 6) as seconds, blocks, gap_blocks, overlap_blocks
from totals join g using (clip_id)""", settle=["packet"])
def flagship(packet):
    index = stage(ix.packet_index(packet), "audio-index")
    gaps = ix.gap_totals(ix.gap_audit(damaged(index))).groupBy("clip_id").agg(
        *[F.sum(n).alias(n) for n in ("blocks", "gap_blocks", "overlap_blocks")])
    return ix.clip_samples(index).withColumn("seconds", F.round(c("total_samples") / 48000, 6)).join(gaps, "clip_id")


@query("src1_typed_scan", ["clip"], "select clip_id, public_uri, rate_num, rate_den, duration_frames from clip")
def src1(clip):
    return clip.select("clip_id", "public_uri", "rate_num", "rate_den", "duration_frames")


@query("p1_track_kind", ["packet"], """
, h as (select clip_id, packet_no, case packet_no % 6 when 0 then 'vide' when 1 then 'soun' when 2 then 'meta' when 3 then 'mdir'
    when 4 then 'mdta' else 'hint' end as handler from packet)
select clip_id, packet_no, case handler when 'vide' then 'video' when 'soun' then 'audio' when 'hint' then 'other' else 'data' end as kind from h""")
def p1_kind(packet):
    codes = F.array(*map(F.lit, ("vide", "soun", "meta", "mdir", "mdta", "hint")))
    return packet.select("clip_id", "packet_no", ix.track_kind(F.get(codes, (c("packet_no") % 6).cast("int"))).alias("kind"))


@query("src2_index_only", ["packet"], "select clip_id, packet_no, essence_key, file_offset, payload_len from packet")
def src2(packet):
    return ix.index_only(packet)


@query("src3_range_extract", ["packet"], INDEX + """
select clip_id, channel, edit_unit, start_sample, sample_count, file_offset from idx
where end_sample > 1200 and start_sample < 2400""", settle=["packet"])
def src3(packet):
    index = ix.stored_index(ix.packet_index(packet), fresh_path(packet.sparkSession, "stored-index"))
    return ix.extract_range(index, 1200, 2400).select(
        "clip_id", "channel", "edit_unit", "start_sample", "sample_count", "file_offset")


@query("p1_essence_class", ["packet"], """
select clip_id, packet_no, case when essence_key like 'pcm.%' then 'pcm' when essence_key like 'avc.%' then 'video'
  when essence_key like 'part.%' then 'partition' when essence_key = 'fill' then 'filler' else 'other' end as kind,
  case when essence_key like 'pcm.%' then cast(substr(essence_key, 5) as int) end as pcm_channel from packet""")
def p1(packet):
    key = c("essence_key")
    return packet.select("clip_id", "packet_no", ix.essence_kind(key).alias("kind"),
                         ix.pcm_channel(key).alias("pcm_channel"))


@query("p3_sample_count", ["packet"], """
select clip_id, packet_no, case when payload_len % 3 = 0 then payload_len // 3 end as sample_count,
  payload_len % 3 = 0 as valid from packet where essence_key like 'pcm.%'""")
def p3(packet):
    n = ix.sample_count(c("payload_len"), c("bit_depth"), F.lit(1))
    return packet.where(c("essence_key").startswith("pcm.")).select(
        "clip_id", "packet_no", n.alias("sample_count"), n.isNotNull().alias("valid"))


@query("p4_extent_validity", ["packet"], """
, f as (select clip_id, max(file_offset + payload_len + 20) - clip_id % 3 * 50 as file_len from packet group by clip_id)
select clip_id, packet_no, cast(file_offset as bigint) as file_offset,
  file_offset < file_len and file_offset + payload_len + 20 <= file_len as extent_ok
from packet join f using (clip_id)""")
def p4(packet):
    length = packet.groupBy("clip_id").agg(F.max(c("file_offset") + c("payload_len") + 20).alias("m")).select(
        "clip_id", (c("m") - c("clip_id") % 3 * 50).alias("file_len"))
    return packet.join(length, "clip_id").select(
        "clip_id", "packet_no", "file_offset",
        ix.extent_ok(c("file_offset"), c("payload_len") + 20, c("file_len")).alias("extent_ok"))


@query("p5_random_access", ["packet"], """
select clip_id, packet_no, picture = 'I' or is_sync as random_access from packet""")
def p5(packet):
    slices = F.array(c("picture"), F.when(c("is_sync"), "IDR").otherwise(c("picture")))
    return packet.select("clip_id", "packet_no", ix.random_access(slices).alias("random_access"))


@query("w1_packet_index", ["packet"], INDEX + """
select clip_id, channel, packet_no, edit_unit, start_sample, sample_count, end_sample, file_offset, payload_len from idx""", settle=["packet"])
def w1(packet):
    return ix.packet_index(packet)


@query("w1_tracks_by_rank", ["packet", "clip"], INDEX + """
, tr as (select clip_id, lane * 7 + 3 as track_id, row_number() over (partition by clip_id order by lane * 7 + 3) - 1 as channel
  from (select clip_id, unnest(range(0, lane_count)) as lane from clip) l)
select clip_id, channel, cast(track_id as int) as track_id, packet_no, start_sample from idx join tr using (clip_id, channel)""", settle=["packet"])
def w1_tracks(packet, clip):
    lanes = clip.where("lane_count > 0").select("clip_id", F.explode(F.sequence(F.lit(0), c("lane_count") - 1)).alias("l"))
    tracks = lanes.select("clip_id", (c("l") * 7 + 3).alias("track_id"))
    return ix.tracks_by_rank(ix.packet_index(packet), tracks).select(
        "clip_id", "channel", "track_id", "packet_no", "start_sample")


@query("w2_gap_audit", ["packet"], GAPS + """
select clip_id, channel, edit_unit, cast(copy as int) as copy, delta, status from audit""", settle=["packet"])
def w2(packet):
    index = stage(ix.packet_index(packet), "audio-index")
    return ix.gap_audit(damaged(index)).select("clip_id", "channel", "edit_unit", "copy", "delta", "status")


@query("w2_gap_totals", ["packet"], GAPS + """
select clip_id, channel, count(*) as blocks, count(*) filter (status = 'gap') as gap_blocks,
  count(*) filter (status = 'overlap') as overlap_blocks, cast(sum(greatest(delta, 0)) as bigint) as gap_samples,
  cast(sum(greatest(-delta, 0)) as bigint) as overlap_samples, bool_and(delta >= 0) as monotonic
from audit group by clip_id, channel""", settle=["packet"])
def w2_totals(packet):
    index = stage(ix.packet_index(packet), "audio-index")
    return ix.gap_totals(ix.gap_audit(damaged(index)))


@query("j1_random_access_lookup", ["command_log", "packet"], REQUESTS + """
, s as (select clip_id, packet_no - 1 as sync_frame from packet where is_sync)
select r.request_id, r.clip_id, r.frame, max(s.sync_frame) as sync_frame
from req r left join s on s.clip_id = r.clip_id and s.sync_frame <= r.frame group by all""", settle=["command_log", "packet"])
def j1(command_log, packet):
    sync = packet.where("is_sync").select("clip_id", (c("packet_no") - 1).alias("sync_frame"))
    asked = requests(command_log).select("request_id", "clip_id", "frame")
    return asof_backward(asked, sync, ["clip_id"], "frame", "request_id", "sync_frame")


@query("j2_index_override", ["packet"], """
, d as (select clip_id, row_number() over (partition by clip_id order by packet_no) - 1 as edit_unit, picture
  from packet where essence_key = 'avc.1'),
n as (select clip_id, max(edit_unit) as last from d group by clip_id),
p as (select clip_id, edit_unit, edit_unit % 12 as key_frame_offset from d join n using (clip_id)
  where clip_id % 4 <> 0 or edit_unit <> last),
m as (select clip_id from (select clip_id, count(*) as a from d group by clip_id) x
  join (select clip_id, count(*) as b from p group by clip_id) y using (clip_id) where a = b)
select d.clip_id, d.edit_unit, case when m.clip_id is not null then 'provided' else 'derived' end as source,
  case when m.clip_id is not null then key_frame_offset = 0 else picture = 'I' end as random_access
from d left join m on m.clip_id = d.clip_id left join p on p.clip_id = d.clip_id and p.edit_unit = d.edit_unit""", settle=["packet"])
def j2(packet):
    video = packet.where("essence_key = 'avc.1'").select("clip_id", "packet_no", "picture")
    derived = ordered_scan(video, ["clip_id"], ["packet_no"], div("packet_no", ROWS_PER_CHUNK), rank="n").select(
        "clip_id", (c("n") - 1).alias("edit_unit"), (c("picture") == "I").alias("random_access"))
    derived = stage(derived, "video-index")
    last = derived.groupBy("clip_id").agg(F.max("edit_unit").alias("last"))
    provided = derived.join(last, "clip_id").where("clip_id % 4 <> 0 or edit_unit <> last").select(
        "clip_id", "edit_unit", (c("edit_unit") % 12).alias("key_frame_offset"))
    return ix.override_index(derived, provided)


@query("j3_range_overlap", ["command_log", "packet"], INDEX + REQUESTS + """
select r.request_id, r.clip_id, i.channel, i.edit_unit, i.start_sample, i.end_sample
from req r join idx i on i.clip_id = r.clip_id and i.end_sample > r.req_start and i.start_sample < r.req_end
where r.req_start < r.req_end""", settle=["packet"])
def j3(command_log, packet):
    asked = requests(command_log).select("request_id", "clip_id", "req_start", "req_end")
    return ix.requests_on_index(asked, ix.packet_index(packet), 64).select(
        "request_id", "clip_id", "channel", "edit_unit", "start_sample", "end_sample")


@query("j4_frame_coverage", ["clip", "packet"], OVERLAPPING + """
, fr as (select clip_id, frame, cast(frame * sample_rate * rate_den // rate_num as bigint) as fs,
    cast((frame + 1) * sample_rate * rate_den // rate_num as bigint) as fe
  from (select *, unnest(range(0, duration_frames)) as frame from clip where duration_frames > 0) x),
reach as (select *, coalesce(max(end_sample) over (partition by clip_id, channel order by start_sample, end_sample
    rows between unbounded preceding and 1 preceding), start_sample) as before from over_),
piece as (select clip_id, channel, greatest(start_sample, before) as ps, end_sample as pe from reach where end_sample > before),
cov as (select f.clip_id, f.frame, p.channel, sum(least(fe, pe) - greatest(fs, ps)) as covered, max(fe - fs) as whole
  from fr f join piece p on p.clip_id = f.clip_id and p.pe > fs and p.ps < fe group by all),
tot as (select clip_id, frame, count(*) as tracks, cast(sum(covered) as bigint) as covered, bool_and(covered = whole) as full_ from cov group by all)
select clip_id, frame, coalesce(tracks, 0) as tracks, coalesce(covered, 0) as covered, coalesce(tracks, 0) = 4 and full_ as complete
from fr left join tot using (clip_id, frame)""", settle=["packet"])
def j4(clip, packet):
    index = stage(ix.packet_index(packet), "audio-index")
    return ix.clip_frame_coverage(clip, overlapping(index), 4)


@query("a1_clip_samples", ["packet"], INDEX + TOTALS + "select clip_id, total_samples, channels from totals", settle=["packet"])
def a1(packet):
    return ix.clip_samples(ix.packet_index(packet))


@query("a3_picture_counts", ["packet"], """
select clip_id, count(*) filter (picture = 'I') as n_i, count(*) filter (picture = 'P') as n_p,
  count(*) filter (picture = 'B') as n_b, count(*) filter (is_sync) as n_sync from packet group by clip_id""")
def a3(packet):
    return ix.picture_counts(packet)


@query("a3_idr_positions", ["packet"], """
select clip_id, packet_no - 1 as position, row_number() over (partition by clip_id order by packet_no) as idr_no
from packet where is_sync""", settle=["packet"])
def a3_idr(packet):
    return ix.idr_positions(packet)


@query("a4_gop_summary", ["packet"], """
, r as (select *, sum(cast(is_sync as int)) over (partition by clip_id order by packet_no) as g from packet)
select clip_id, cast(g as bigint) as gop_no, count(*) as length, cast(sum(payload_len) as bigint) as bytes,
  min(packet_no) as first_packet, max(packet_no) as last_packet from r group by clip_id, g""", settle=["packet"])
def a4(packet):
    return ix.gop_summary(packet)


@query("a5_format_homogeneity", ["clip"], """
select project_id, case when min(sample_rate) = max(sample_rate) then min(sample_rate)::varchar else 'mixed' end as sample_rate,
  case when min(bit_depth) = max(bit_depth) then min(bit_depth)::varchar else 'mixed' end as bit_depth,
  case when min(lane_count) = max(lane_count) then min(lane_count)::varchar else 'mixed' end as lane_count,
  case when min(video_depth) = max(video_depth) then min(video_depth)::varchar else 'mixed' end as video_depth,
  count(*) as clips from clip group by project_id""")
def a5(clip):
    return ix.format_homogeneity(clip, "project_id")


@query("a6_limit_audit", ["packet"], """
, ch as (select clip_id, channel, count(*) as n, max(payload_len) as largest,
  max(case when essence_key like 'pcm.%' then cast(substr(essence_key, 5) as bigint) end) as number from packet group by all),
cl as (select clip_id, cast(sum(n) as bigint) as packets, count(*) as channels, max(largest) as largest, max(number) as number from ch group by clip_id),
l as (select 'entries_per_channel' as cap, clip_id, channel, n as value, cast(180 as bigint) as allowed from ch
  union all select 'packets_per_clip', clip_id, -1, packets, 600 from cl
  union all select 'channels_per_clip', clip_id, -1, channels, 3 from cl
  union all select 'payload_bytes', clip_id, -1, largest, 149 from cl
  union all select 'channel_number', clip_id, -1, number, 2 from cl)
select cap, clip_id, channel, value, allowed from l where value > allowed""")
def a6(packet):
    return ix.limit_audit(packet, {
        "entries_per_channel": 180, "packets_per_clip": 600, "channels_per_clip": 3, "payload_bytes": 149, "channel_number": 2})


@query("a16_corpus_summary", ["packet"], INDEX + """
, ch as (select clip_id, channel, count(*) as n, sum(payload_len) as b, sum(sample_count) as s from idx group by all)
select clip_id, channel, cast(grouping(clip_id, channel) as int) as level, count(*) as tracks, cast(sum(n) as bigint) as packets,
  cast(sum(b) as bigint) as bytes, round(cast(sum(s) as double) / 48000, 6) as seconds from ch group by rollup (clip_id, channel)""", settle=["packet"])
def a16(packet):
    return ix.corpus_summary(ix.packet_index(packet))


@query("a18_cut_summary", ["clip"], """
, k as (select clip_id, rate_num, rate_den, range_start as i, least(range_end, duration_frames) as o from clip)
select clip_id, greatest(o - i, 0) as source_frames,
  case when o > i then (o + 1) // 2 - (i + 1) // 2 else 0 end as preview_frames,
  greatest(o - i, 0) - case when o > i then (o + 1) // 2 - (i + 1) // 2 else 0 end as skipped,
  round(cast(greatest(o - i, 0) * rate_den as double) / rate_num, 6) as seconds from k""")
def a18(clip):
    cuts = clip.select("clip_id", "rate_num", "rate_den", c("range_start").alias("cut_in"),
                       F.least("range_end", "duration_frames").alias("cut_out"))
    return ix.cut_summary(cuts, 2)


@query("a19_av_extent", ["clip", "packet"], INDEX + TOTALS + """
, fr as (select clip_id, total_samples, cast((frame + 1) * sample_rate * rate_den // rate_num as bigint) as fe from
    (select *, unnest(range(0, duration_frames)) as frame from clip) x join totals using (clip_id) where frame % 2 = 0),
o as (select clip_id, count(*) filter (fe > total_samples) as n from fr group by clip_id)
select clip_id, round(cast(total_samples as double) / sample_rate - cast(duration_frames * rate_den as double) / rate_num, 6)
  as delta_seconds, coalesce(n, 0) as outside_frames
from clip join totals using (clip_id) left join o using (clip_id)""", settle=["packet"])
def a19(clip, packet):
    return ix.av_extent(clip, ix.packet_index(packet))
