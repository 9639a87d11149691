"""T1-T10: frame and sample time over every clip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timing as t
from ..operators import index as ix
from ..operators.scan import div
from ..operators.interval import overlap_counts
from .registry import query
from .snippets import INDEX, REQUESTS, requests

c = F.col
FRAMES = """, frames as (select *, unnest(range(0, duration_frames)) as frame from clip where duration_frames > 0)"""


@query("t1_frame_timeline", ["clip"], FRAMES + """
select clip_id, frame, cast(cast(frame as hugeint) * rate_den * 1000000000 // rate_num as bigint) as offset_ns
from frames""")
def t1(clip):
    return t.frame_timeline(clip).select("clip_id", "frame", "offset_ns")


@query("t2_frame_samples", ["clip"], FRAMES + """
select clip_id, frame, cast(frame * sample_rate * rate_den // rate_num as bigint) as start_sample,
  cast((frame + 1) * sample_rate * rate_den // rate_num as bigint) as end_sample from frames""")
def t2(clip):
    return t.frame_samples(clip).select("clip_id", "frame", "start_sample", "end_sample")


@query("t3_frame_interval", ["clip"], """
select clip_id, cast((1000000000 * cast(rate_den as bigint) + rate_num - 1) // rate_num as bigint) as interval_ns
from clip""")
def t3(clip):
    return clip.select("clip_id", t.interval_ns(c("rate_num"), c("rate_den")).alias("interval_ns"))


@query("t4_latest_due", ["clip"], """
select clip_id, cast(elapsed_ms as int) as elapsed_ms,
  least(range_start + cast(elapsed_ms as bigint) * rate_num // (rate_den * 1000), range_end - 1) as due_frame
from clip, (values (0), (60), (1000)) e(elapsed_ms) where range_start < range_end""")
def t4(clip):
    at = clip.where("range_start < range_end").withColumn("elapsed_ms", F.explode(F.array(*map(F.lit, (0, 60, 1000)))))
    due = t.due_frame(c("elapsed_ms"), c("range_start"), c("range_end"), c("rate_num"), c("rate_den"))
    return at.select("clip_id", "elapsed_ms", due.alias("due_frame"))


@query("t5_due_drain", ["clip"], """
, ticks as (select clip_id, range_start, range_end, rate_num, rate_den, mode, last_ms, now_ms,
    case mode when 'double' then 2 when 'still' then 0 else 1 end as speed
  from clip, (values ('forward'), ('still'), ('reverse'), ('double')) m(mode),
    (values (null, 60), (60, 200)) k(last_ms, now_ms) where range_start < range_end and mode <> 'still'),
steps as (select *, case when last_ms is null then 0
      else least(cast(last_ms as bigint) * rate_num * speed // (rate_den * 1000), range_end - range_start - 1) + 1 end as a,
    least(cast(now_ms as bigint) * rate_num * speed // (rate_den * 1000), range_end - range_start - 1) as b from ticks),
opened as (select *, unnest(range(a, b + 1)) as step from steps where a <= b)
select clip_id, mode, cast(now_ms as int) as now_ms,
  case when mode = 'reverse' then range_end - 1 - step else range_start + step end as frame from opened""")
def t5(clip):
    tick = lambda last, now: F.struct(F.lit(last).cast("int").alias("last_ms"), F.lit(now).alias("now_ms"))
    ticks = clip.withColumn("mode", F.explode(F.array(*map(F.lit, ("forward", "still", "reverse", "double"))))).withColumn(
        "k", F.explode(F.array(tick(None, 60), tick(60, 200)))).select("*", "k.last_ms", "k.now_ms")
    return t.due_drain(ticks).select("clip_id", "mode", "now_ms", "frame")


@query("t6_rate_equality", ["clip", "proxy"], """
select c.clip_id, cast(c.rate_num as bigint) * p.rate_den = cast(p.rate_num as bigint) * c.rate_den as equal_rate,
  c.rate_num = p.rate_num and c.rate_den = p.rate_den as strict_equal
from clip c join proxy p using (clip_id)""")
def t6(clip, proxy):
    p = proxy.select("clip_id", c("rate_num").alias("p_num"), c("rate_den").alias("p_den"))
    parts = (c("rate_num"), c("rate_den"), c("p_num"), c("p_den"))
    return clip.join(p, "clip_id").select(
        "clip_id", t.rates_equal(*parts).alias("equal_rate"), t.rates_equal(*parts, strict=True).alias("strict_equal"))


@query("t7_derived_rate", ["packet"], """
select clip_id, case when sum(duration) > 0 then cast(count(*) * 90000 as bigint) else 0 end as rate_num,
  case when sum(duration) > 0 then cast(sum(duration) as bigint) else 1 end as rate_den from packet group by clip_id""")
def t7(packet):
    return ix.derived_rate(packet, 90000)


@query("t8_pts_dts", ["packet"], """
, d as (select clip_id, packet_no, composition_offset,
  cast(sum(duration) over (partition by clip_id order by packet_no) - duration as bigint) as dts from packet)
select clip_id, packet_no, dts, dts + composition_offset as pts from d""", settle=["packet"])
def t8(packet):
    return ix.presentation_times(packet)


@query("t9_media_time", ["clip"], """
, m as (select clip_id, cast(cast(clip_id as hugeint) * rate_den * 1000 // rate_num as bigint) as ms from clip)
select clip_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as media_time
from m""")
def t9(clip):
    return clip.select("clip_id", t.media_time_text(c("clip_id"), c("rate_num"), c("rate_den")).alias("media_time"))


@query("t10_ms_to_blocks", ["command_log", "packet"], INDEX + """
, req as (select command_id as request_id, session_id as clip_id, frame * 48000 // 1000 as req_start,
    (frame + 40) * 48000 // 1000 as req_end from command_log where command in ('Seek', 'Cue'))
select r.request_id, r.clip_id, r.req_start, r.req_end, count(i.clip_id) as blocks
from req r left join idx i on i.clip_id = r.clip_id and i.end_sample > r.req_start and i.start_sample < r.req_end
group by all""", settle=["packet", "command_log"])
def t10(command_log, packet):
    asked = command_log.where("command in ('Seek', 'Cue')").select(
        c("command_id").alias("request_id"), c("session_id").alias("clip_id"),
        t.ms_to_sample(c("frame"), 48000).alias("req_start"), t.ms_to_sample(c("frame") + 40, 48000).alias("req_end"))
    return overlap_counts(
        asked, ix.packet_index(packet), ["clip_id"], "req_start", "req_end", "start_sample", "end_sample", "blocks")
