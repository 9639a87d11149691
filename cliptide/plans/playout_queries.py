"""Playout reports over frame decisions, stage timings and resource logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import playout as po
from .registry import query

c = F.col


@query("a8_decision_reconciliation", ["frame_decision"], """
, l as (select *, case when duplicated then 'Duplicated' when lateness_ms <= 5 then 'OnTime' when lateness_ms <= 40 then 'Late'
  else 'Dropped' end as label from frame_decision),
s as (select run_id, count(*) filter (label = 'OnTime') as presented, count(*) filter (label = 'Late') as late,
  count(*) filter (label = 'Dropped') as dropped, count(*) filter (label = 'Duplicated') as duplicated,
  max(frame) + 1 as source_frames from l group by run_id)
select *, presented + late + dropped + duplicated = source_frames as reconciled from s""")
def a8(frame_decision):
    return po.reconcile(frame_decision)


@query("a9_lateness_distribution", ["frame_decision"], """
, u as (select run_id, cast(round(lateness_ms * 1000) as bigint) as us from frame_decision)
select run_id, round(max(us) / 1000.0::double, 6) as max_ms, round(sum(us)::double / count(*) / 1000, 6) as mean_ms,
  round(quantile_cont(us, 0.5) / 1000.0::double, 6) as median_ms, round(quantile_cont(us, 0.9) / 1000.0::double, 6) as p90_ms
from u group by run_id""", settle=["frame_decision"])
def a9(frame_decision):
    return po.lateness_distribution(frame_decision)


@query("a9_lateness_sketch", ["frame_decision"], """
select run_id, max(lateness_ms) as max_ms, quantile_disc(lateness_ms, 0.5) as median_ms, quantile_disc(lateness_ms, 0.9) as p90_ms
from frame_decision group by run_id""", settle=["frame_decision"])
def a9_sketch(frame_decision):
    """The sketch holds runs of fewer rows than half its accuracy exactly; beyond that its ranks are off by 1 / accuracy at most."""
    return po.lateness_sketch(frame_decision, 100_000)


BREAKDOWN = """
, s as (select run_id, stage, cast(sum(cast(round(ms * 1000) as bigint)) as bigint) as us, count(*) as frames from stage_timing group by all),
r as (select run_id, sum(us)::bigint as run_us, sum(frames)::bigint as run_frames from s group by run_id)"""


@query("a10_stage_breakdown", ["stage_timing"], BREAKDOWN + """
select run_id, stage, frames, round(us / 1000.0::double, 6) as total_ms, round(us::double / frames / 1000, 6) as avg_ms,
  round(us::double / nullif(run_us, 0), 6) as share, round(run_frames * 1000000::double / run_us, 6) as fps,
  round(run_frames * 1000000::double / run_us / 50, 6) as realtime from s join r using (run_id)""")
def a10(stage_timing):
    return po.stage_breakdown(stage_timing)


@query("w9_share_of_total", ["stage_timing"], BREAKDOWN + """
select run_id, stage, round(us::double / nullif(run_us, 0), 6) as share from s join r using (run_id)""")
def w9(stage_timing):
    return po.stage_breakdown(stage_timing).select("run_id", "stage", "share")


DEPTH = """
, d as (select *, cast(sum(case op when 'create' then 1 else -1 end) over (partition by session_id order by seq, resource_id, op) as bigint)
  as depth from resource_log)"""


@query("w7_queue_depth", ["resource_log"], DEPTH + """
select session_id, resource_id, op, seq, depth, op = 'create' and depth > 4 as backpressure from d""")
def w7(resource_log):
    return po.queue_depth(resource_log, "session_id", 4)


@query("w7_queue_summary", ["resource_log"], DEPTH + """
, t as (select *, case when lag(depth) over w > 4 then seq - lag(seq) over w else 0 end as above from d
  window w as (partition by session_id order by seq, resource_id, op))
select session_id, max(depth) as peak, cast(sum(above) as bigint) as time_above, count(*) filter (depth > 4) as above_capacity,
  count(*) filter (op = 'create' and depth > 4) as backpressure from t group by session_id""")
def w7_summary(resource_log):
    return po.queue_summary(resource_log, "session_id", 4)


@query("s3_selection_completeness", ["frame_decision"], """
, f as (select run_id, frame, true as src, frame % 2 = 0 or frame % 10 = 5 as sel, frame % 2 <> 0 and frame % 14 <> 7 as skip from frame_decision
  union all select distinct run_id, -1, false, false, true from frame_decision where run_id % 3 = 0)
select run_id, count(*) filter (sel) as selected, count(*) filter (skip) as skipped, count(*) filter (src) as source,
  count(*) filter (sel and skip) as in_both, count(*) filter (src and not sel and not skip) as in_neither,
  count(*) filter (not src) as not_in_source from f group by run_id""", settle=["frame_decision"])
def s3(frame_decision):
    # Planted: frames that are both selected and skipped, frames that are neither, and a frame that no source has.
    stray = frame_decision.where("run_id % 3 = 0").select("run_id", F.lit(-1).cast("bigint").alias("frame"))
    skipped = frame_decision.where("frame % 2 <> 0 and frame % 14 <> 7").select("run_id", "frame").unionByName(stray)
    return po.selection_completeness(frame_decision, frame_decision.where("frame % 2 = 0 or frame % 10 = 5"), skipped)


@query("j16_presentation_slots", ["frame_decision", "packet"], """
, v as (select run_id, frame, case when frame % 10 = 4 then 'CapabilityMissing' else 'Prepared' end as video_status,
    row_number() over (partition by run_id order by frame) as slot from frame_decision where frame % 2 = 0),
a as (select clip_id as run_id, packet_no, payload_len % 3 = 0 as audio_complete,
    row_number() over (partition by clip_id order by packet_no) as slot from packet where essence_key = 'pcm.1')
select v.run_id, v.slot - 1 as slot, frame, packet_no, case when video_status <> 'Prepared' then video_status
  when packet_no is null then 'MissingAudio' when not audio_complete then 'IncompleteAudio' else 'Ready' end as status
from v left join a on a.run_id = v.run_id and a.slot = v.slot""", settle=["frame_decision", "packet"])
def j16(frame_decision, packet):
    video = frame_decision.where("frame % 2 = 0").select(
        "run_id", "frame", F.when(c("frame") % 10 == 4, "CapabilityMissing").otherwise("Prepared").alias("video_status"))
    audio = packet.where("essence_key = 'pcm.1'").select(
        c("clip_id").alias("run_id"), "packet_no", (c("payload_len") % 3 == 0).alias("audio_complete"))
    return po.presentation_slots(video, audio)
