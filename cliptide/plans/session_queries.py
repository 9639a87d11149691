"""Command replays, what follows from them, prepared windows and picture order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timing import sample_at
from ..operators import pictures as pic
from ..operators import player as pl
from ..operators.scan import ROWS_PER_CHUNK, div, ordered_scan
from ..sources import stage
from .registry import query

c = F.col

# One command at a time by recursion: the sequential definition of the replay.
REPLAY = """, calls as materialized (select session_id, seq, command,
    case when command <> 'Preroll' or command_id % 7 = 0 then frame end as target, frame_count, expected_generation as expected,
    range_start as rs, range_end as re from ranged_log),
states as (
  select distinct session_id, cast(0 as bigint) as seq, cast(null as varchar) as command, true as accepted, cast(null as varchar) as reason,
    'Empty' as status, false as loaded, false as has_range, cast(null as bigint) as frame, false as armed, cast(0 as bigint) as generation,
    cast(null as bigint) as range_start, cast(null as bigint) as range_end
  from calls
  union all
  select session_id, seq, command, reason is null, reason,
    case when reason is not null or command = 'Snapshot' then status when command = 'LoadPreparedInput' then 'Loaded' when command = 'Cue' then 'Ready'
      when command = 'Play' then case when frame + coalesce(frame_count, 0) >= range_end then 'Completed' else 'Playing' end
      when command = 'Pause' then 'Paused' when command = 'Stop' then 'Stopped' when command = 'Unload' then 'Empty' else status end,
    case when reason is not null then loaded when command = 'LoadPreparedInput' then true when command = 'Unload' then false else loaded end,
    case when reason is not null then has_range when command = 'Prepare' then true when command in ('LoadPreparedInput', 'Unload') then false
      else has_range end,
    case when reason is not null then frame when command in ('LoadPreparedInput', 'Unload') then null when command in ('Cue', 'Seek') then target
      when command = 'Preroll' then coalesce(target, frame)
      when command = 'Play' then least(frame + coalesce(frame_count, 0), range_end - 1) else frame end,
    case when reason is not null then armed when command in ('LoadPreparedInput', 'Unload', 'Seek', 'Stop') then false
      when command in ('Cue', 'Preroll') then true when command = 'Prepare' then armed or frame is not null
      when command = 'Play' and frame + coalesce(frame_count, 0) >= range_end then false else armed end,
    generation + case when reason is null and command <> 'Snapshot' then 1 else 0 end,
    case when reason is not null then range_start when command = 'Prepare' then rs when command in ('LoadPreparedInput', 'Unload') then null else range_start end,
    case when reason is not null then range_end when command = 'Prepare' then re when command in ('LoadPreparedInput', 'Unload') then null else range_end end
  from (select s.status, s.loaded, s.has_range, s.frame, s.armed, s.generation, s.range_start, s.range_end, k.*,
      case when k.command = 'Snapshot' then null
        when k.expected is not null and k.expected <> s.generation then 'StaleGeneration'
        when k.command = 'LoadPreparedInput' then case when s.loaded then 'SourceAlreadyLoaded' end
        when not s.loaded then 'SourceNotLoaded'
        when k.command in ('Cue', 'Seek') or (k.command = 'Preroll' and k.target is not null) then case
          when not s.has_range then 'PrepareRequired' when k.target < s.range_start or k.target >= s.range_end
          then case k.command when 'Seek' then 'Seek' else 'Cue' end || 'OutsideActiveRange' end
        when k.command = 'Preroll' then case when s.frame is null then 'PrepareRequired' end
        when k.command = 'Play' then case when (s.status = 'Playing' and k.frame_count is not null)
            or (s.armed and s.status in ('Ready', 'Paused')) then null
          when s.status in ('Loaded', 'Ready', 'Paused') then 'PrepareRequired' else 'IllegalCommandForState' end
        when k.command = 'Pause' and s.status <> 'Playing' then 'IllegalCommandForState' end as reason
    from states s join calls k on k.session_id = s.session_id and k.seq = s.seq + 1) x),
replayed as materialized (select * from states where seq > 0)"""


def targets(command_log):
    """The log with a target frame on one Preroll in seven; the others take the frame at hand."""
    return command_log.withColumn("frame", F.when((c("command") != "Preroll") | (c("command_id") % 7 == 0), c("frame")))


def _replayed(command_log):
    return pl.replay(targets(command_log))


def _settled(command_log):
    """The replay written out, for scans that read it twice: it must not be folded for each reading."""
    return stage(_replayed(command_log), "replay")


@query("r1_player_replay", ["ranged_log"], REPLAY + """
select session_id, seq, command, accepted, reason, status, loaded, has_range, frame, armed, generation, range_start, range_end from replayed""", recursive=True)
def r1(command_log):
    return _replayed(command_log)


@query("r1_block_parallel_replay", ["ranged_log"], REPLAY + """
select session_id, seq, command, accepted, reason, status, loaded, has_range, frame, armed, generation, range_start, range_end from replayed""", recursive=True)
def r1_blocks(command_log):
    """The same replay with every session cut into blocks of 24 commands."""
    return pl.replay(targets(command_log), block_rows=24)


@query("r3_generation_check", ["ranged_log"], REPLAY + """
, b as (select *, lag(status) over w as status_before, lag(generation) over w as generation_before from replayed
  window w as (partition by session_id order by seq))
select session_id, seq, accepted, status = coalesce(status_before, 'Empty') and generation = coalesce(generation_before, 0) as unchanged
from b where reason = 'StaleGeneration'""", recursive=True)
def r3(command_log):
    seen = ordered_scan(
        _settled(command_log), ["session_id"], ["seq"], div("seq", ROWS_PER_CHUNK),
        lags={"s0": c("status"), "g0": c("generation")})
    same = (c("status") == F.coalesce("s0", F.lit("Empty"))) & (c("generation") == F.coalesce("g0", F.lit(0)))
    return seen.where("reason = 'StaleGeneration'").select("session_id", "seq", "accepted", same.alias("unchanged"))


LIFE = """, ops as materialized (select session_id, seq, case command when 'LoadPreparedInput' then 'NewSession' when 'Cue' then 'Prepare'
    when 'Preroll' then 'Prepare' when 'Unload' then 'Drained' when 'Stop' then case when frame % 2 = 0 then 'Stop' else 'Drain' end
    when 'Snapshot' then 'Drain' else command end as op,
    frame < 106 as facts_ok, frame % 3 <> 0 as preroll_ready from command_log)"""


def life_ops(command_log):
    return command_log.selectExpr(
        "session_id", "seq", """case command when 'LoadPreparedInput' then 'NewSession' when 'Cue' then 'Prepare'
          when 'Preroll' then 'Prepare' when 'Unload' then 'Drained' when 'Stop' then case when frame % 2 = 0 then 'Stop' else 'Drain' end
          when 'Snapshot' then 'Drain' else command end as op""",
        "frame < 106 as facts_ok", "frame % 3 <> 0 as preroll_ready")


@query("r2_lifecycle_replay", ["ranged_log"], LIFE + """
, st as (
  select distinct session_id, cast(0 as bigint) as seq, cast(null as varchar) as op, true as accepted, 'Idle' as status, cast(0 as bigint) as run from ops
  union all
  select session_id, seq, op, ok, case when not ok then status when op = 'NewSession' then 'Idle'
      when op = 'Prepare' then case when not facts_ok then 'Failed' when preroll_ready then 'Ready' else 'Preparing' end
      when op = 'Play' then 'Playing' when op = 'Pause' then 'Paused' when op in ('Stop', 'Drained') then 'Completed'
      when op = 'Drain' then 'Draining' else status end,
    run + case when op = 'NewSession' then 1 else 0 end
  from (select s.status, s.run, k.*, case k.op when 'NewSession' then true when 'Prepare' then s.status in ('Idle', 'Preparing')
      when 'Play' then s.status in ('Ready', 'Paused') when 'Pause' then s.status = 'Playing' when 'Drain' then s.status in ('Playing', 'Paused')
      when 'Drained' then s.status = 'Draining' else s.status in ('Ready', 'Playing', 'Paused') end as ok
    from st s join ops k on k.session_id = s.session_id and k.seq = s.seq + 1) x)
select session_id, seq, op, accepted, status, run from st where seq > 0""", recursive=True)
def r2(command_log):
    return pl.lifecycle_replay(life_ops(command_log))


SRC_OPS = """, opened as (select session_id, seq, sub, frame as target, expected_generation is not null as stale, range_start, range_end, case
    when command = 'LoadPreparedInput' then 'load_source' when command = 'Prepare' then case sub when 0 then 'preload_source' else 'set_active_source' end
    when command = 'Cue' then case sub when 0 then 'set_active_range' else 'cue_frame' end when command = 'Preroll' then 'prepare_anchor'
    when command = 'Play' then 'play' when command = 'Pause' then 'pause' when command = 'Seek' then 'cue_frame' when command = 'Stop' then 'stop'
    when command = 'Unload' then 'unload_source' else 'close_active_source' end as op
  from (select *, unnest(case when command in ('Prepare', 'Cue') then [0, 1] else [0] end) as sub from ranged_log) e),
ops as materialized (select *, row_number() over (partition by session_id order by seq, sub) as n from opened)"""


def source_ops(command_log):
    subs = F.when(c("command").isin("Prepare", "Cue"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    first = lambda a, b: F.when(c("sub") == 0, a).otherwise(b)
    op = (
        F.when(c("command") == "LoadPreparedInput", "load_source")
        .when(c("command") == "Prepare", first("preload_source", "set_active_source"))
        .when(c("command") == "Cue", first("set_active_range", "cue_frame")).when(c("command") == "Preroll", "prepare_anchor")
        .when(c("command") == "Play", "play").when(c("command") == "Pause", "pause").when(c("command") == "Seek", "cue_frame")
        .when(c("command") == "Stop", "stop").when(c("command") == "Unload", "unload_source").otherwise("close_active_source"))
    return command_log.withColumn("sub", F.explode(subs)).select(
        "session_id", "seq", "sub", op.alias("op"), c("frame").alias("target"), c("expected_generation").isNotNull().alias("stale"),
        "range_start", "range_end")


@query("r4_source_lifecycle", ["ranged_log"], SRC_OPS + """
, st as (
  select distinct session_id, cast(0 as bigint) as n, cast(0 as bigint) as seq, 0 as sub, cast(null as varchar) as op, true as accepted,
    false as loaded, false as preloaded, false as active, false as ranged, cast(null as bigint) as cue, false as anchored, false as playing,
    cast(0 as bigint) as revision from ops
  union all
  select session_id, n, seq, sub, op, ok,
    case when not ok then loaded when op = 'load_source' then true when op = 'unload_source' then false else loaded end,
    case when not ok then preloaded when op = 'preload_source' then true when op = 'unload_source' then false else preloaded end,
    case when not ok then active when op = 'set_active_source' then true when op in ('unload_source', 'close_active_source') then false else active end,
    case when not ok then ranged when op = 'set_active_range' then true
      when op in ('set_active_source', 'unload_source', 'close_active_source') then false else ranged end,
    case when not ok then cue when op = 'cue_frame' then target
      when op in ('set_active_source', 'set_active_range', 'unload_source', 'close_active_source') then null else cue end,
    case when not ok then anchored when op = 'prepare_anchor' then true
      when op in ('set_active_source', 'set_active_range', 'cue_frame', 'unload_source', 'close_active_source') then false else anchored end,
    case when not ok then playing when op = 'play' then true
      when op in ('set_active_source', 'pause', 'stop', 'unload_source', 'close_active_source') then false else playing end,
    revision + case when ok and op = 'load_source' then 1 else 0 end
  from (select s.loaded, s.preloaded, s.active, s.ranged, s.cue, s.anchored, s.playing, s.revision, k.*,
      case when k.op = 'load_source' then not s.loaded when k.stale or not s.loaded then false
        when k.op in ('preload_source', 'set_active_source', 'unload_source') then true when not s.active then false
        when k.op = 'cue_frame' then s.ranged and k.target >= k.range_start and k.target < k.range_end when k.op = 'prepare_anchor' then s.preloaded and s.cue is not null
        when k.op = 'play' then s.preloaded and s.ranged and s.cue is not null and s.anchored when k.op in ('pause', 'stop') then s.playing
        else true end as ok
    from st s join ops k on k.session_id = s.session_id and k.n = s.n + 1) x)
select session_id, seq, cast(sub as int) as sub, op, accepted, loaded, active, cue,
  active and preloaded and ranged and cue is not null and anchored as play_ready, playing, revision from st where n > 0""", recursive=True)
def r4(command_log):
    return pl.source_replay(source_ops(command_log))


@query("r6_coverage_cursor", ["ranged_log"], """
, ops as materialized (select session_id, seq, frame, command in ('Seek', 'Stop') as reset from command_log),
st as (
  select distinct session_id, cast(0 as bigint) as seq, cast(null as varchar) as label, cast(0 as bigint) as covered_until, false as submitted,
    cast(0 as bigint) as submissions from ops
  union all
  select session_id, seq, case when reset then 'reset' when frame * 960 >= covered_until then 'submitted' when submitted then 'covered' else 'pending' end,
    case when reset then 0 when frame * 960 >= covered_until then frame * 960 + 24000 else covered_until end,
    submitted or (not reset and frame * 960 >= covered_until),
    submissions + case when not reset and frame * 960 >= covered_until then 1 else 0 end
  from (select s.covered_until, s.submitted, s.submissions, k.* from st s join ops k on k.session_id = s.session_id and k.seq = s.seq + 1) x)
select session_id, seq, label, covered_until, submissions from st where seq > 0""", recursive=True)
def r6(command_log):
    ticks = command_log.select(
        "session_id", "seq", "frame", F.when(c("command").isin("Seek", "Stop"), "reset").otherwise("tick").alias("op"))
    return pl.coverage_replay(ticks)


ORDERED = """, o as (select *, row_number() over (partition by clip_id, segment_true order by poc_true) - 1 as present_no,
    decode_no - min(decode_no) over (partition by clip_id, segment_true) as local_no from picture)"""


@query("w5_counter_unroll", ["picture"], """
select clip_id, decode_no, segment_true + 1 as segment, poc_lsb, poc_true as poc from picture""", settle=["picture"])
def w5(picture):
    return pic.unroll_order(picture, 256)


@query("w6_presentation_order", ["picture"], ORDERED + """
select clip_id, segment_true as segment, decode_no, poc_true as poc, present_no, present_no - local_no as displacement from o""", settle=["picture"])
def w6(picture):
    known = picture.select("clip_id", c("segment_true").alias("segment"), "decode_no", c("poc_true").alias("poc"))
    return pic.presentation_order(known)


@query("r5_reorder_buffer", ["picture"], """
select clip_id, row_number() over (partition by clip_id order by segment_true, poc_true) as release_no, decode_no, poc_true as poc from picture""", settle=["picture"])
def r5(picture):
    known = picture.select("clip_id", c("segment_true").alias("segment"), "decode_no", c("poc_true").alias("poc"))
    return pic.release_order(stage(pic.presentation_order(known), "presented"))


@query("r5_reorder_peak", ["picture"], """
, n as (select clip_id, segment_true, count(*) as n from picture group by all)
select clip_id, cast(least(max(n), 3) as bigint) as peak_waiting, cast(sum(n) as bigint) as released from n group by clip_id""")
def r5_peak(picture):
    return pic.release_peak(picture.select("clip_id", c("segment_true").alias("segment")), 2)


@query("w3_sequence_audit", ["transcript"], """
, s as (select *, lag(seq) over w as prev_seq, lag(generation) over w as prev_generation from transcript window w as (partition by session_id order by seq))
select session_id, seq, case when prev_seq is null then 'first' when seq <= prev_seq then 'not-increasing' when seq > prev_seq + 1 then 'gap'
  else 'ok' end as status, coalesce(generation < prev_generation, false) as generation_back from s""")
def w3(transcript):
    return pl.sequence_audit(transcript).select("session_id", "seq", "status", "generation_back")


@query("w4_generation_numbering", ["ranged_log"], REPLAY + "select session_id, seq, command, accepted, generation from replayed", recursive=True)
def w4(command_log):
    return pl.generation_numbers(_settled(command_log))


@query("w10_latest_snapshot", ["ranged_log"], REPLAY + """
select session_id, seq, status, frame, armed, generation from (select *, row_number() over (partition by session_id order by seq desc) as place
  from replayed) x where place = 1""", recursive=True)
def w10(command_log):
    return pl.latest_snapshot(_replayed(command_log))


CHANGES = REPLAY + """, ch as (select * from (select session_id, seq, status, lag(status) over (partition by session_id order by seq) as previous
  from replayed) x where previous is null or status <> previous)"""


@query("w11_state_changes", ["ranged_log"], CHANGES + "select session_id, seq, previous, status from ch", recursive=True)
def w11(command_log):
    return pl.state_changes(_settled(command_log))


@query("w11_transition_counts", ["ranged_log"], CHANGES + """
select previous, status, count(*) as times from ch where previous is not null group by all""", recursive=True)
def w11_counts(command_log):
    return pl.transition_counts(pl.state_changes(_settled(command_log)))


def _dimension_sql() -> str:
    rows = ", ".join(f"('{k}', '{s}', '{o}', {str(r).lower()}, '{a}')" for k, (s, o, r, a) in pl.FAULTS.items())
    return f", dim as (select * from (values {rows}) d(reason, severity, scope, recoverable, action))"


FAULTS = REPLAY + _dimension_sql() + """, faults as (select session_id, seq, command, reason, severity, scope, recoverable, action
  from replayed left join dim using (reason) where reason is not null)"""


@query("j14_fault_enrichment", ["ranged_log"], FAULTS + "select * from faults", recursive=True)
def j14(command_log):
    return pl.enrich_faults(_replayed(command_log))


@query("a11_fault_counters", ["ranged_log"], FAULTS + """
select severity, scope, cast(grouping(severity, scope) as int) as level, count(*) as faults,
  arg_max(reason, [seq, session_id]) as last_fault, count(*) filter (recoverable) as recoverable, count(*) filter (severity = 'Fatal') as fatal
from faults group by cube (severity, scope)""", recursive=True)
def a11(command_log):
    return pl.fault_counters(pl.enrich_faults(_replayed(command_log)))


@query("a12_command_counters", ["ranged_log"], REPLAY + """
select session_id, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as rejected, cast(0 as bigint) as mutated_by_rejection
from replayed group by session_id""", recursive=True)
def a12(command_log):
    return pl.command_counters(_settled(command_log))


@query("a13_duplicate_commands", ["ranged_log"], """
select session_id, command_id % 40 as command_id, count(*) as copies from command_log group by all having count(*) > 1""")
def a13(command_log):
    return pl.duplicate_commands(command_log.withColumn("command_id", c("command_id") % 40))


FACTS = REPLAY + """, rated as (select r.*, l.public_uri, coalesce(l.lane_count, 0) as lane_count, coalesce(l.audio_authority, 'Original') as audio_authority,
    case when session_id % 41 = 0 then 0 else 25 end as rate_num, 1 as rate_den
  from replayed r left join clip l on l.clip_id = r.session_id),
snap as (select *, session_id % 31 = 0 as private_path_exposed,
    session_id % 37 = 0 as proxy_aac_authoritative, armed and status in ('Ready', 'Paused') as transport_ready,
    case session_id % 3 when 0 then 'OriginalMedia' when 1 then 'ProxyPreview' end as source_mode,
    case when rate_num > 0 then frame * 1920 end as sample_start, case when rate_num > 0 then frame * 1920 + 1920 end as sample_end,
    case when armed then greatest(least(range_end - frame, 8), 0) else 0 end as prepared_frames,
    armed and range_end - frame >= 3 as video_payload_ready, armed and rate_num > 0 as audio_payload_ready,
    session_id % 5 = 0 as visual_verified, session_id % 7 = 0 as realtime_verified, session_id % 11 = 0 as audio_device_verified,
    session_id % 13 = 0 as av_sync_verified from rated)"""


def facts(outcomes, clip):
    """Outcomes with what a snapshot says besides the state: the clip's URI, lanes and authority, flags by rule."""
    s, left = c("session_id"), c("range_end") - c("frame")
    source = clip.select(c("clip_id").alias("session_id"), "public_uri", "lane_count", "audio_authority")
    timed = outcomes.join(source, "session_id", "left").withColumns({"rate_num": F.when(s % 41 == 0, 0).otherwise(25), "rate_den": F.lit(1)})
    first = lambda frame: F.when(c("rate_num") > 0, sample_at(frame, F.lit(48000), c("rate_num"), c("rate_den")))
    return timed.withColumns({
        "lanes": pl.source_lanes(c("lane_count")), "audio_authority": F.coalesce("audio_authority", F.lit("Original")),
        "private_path_exposed": s % 31 == 0, "proxy_aac_authoritative": s % 37 == 0,
        "transport_ready": c("armed") & c("status").isin("Ready", "Paused"),
        "source_mode": F.when(s % 3 == 0, "OriginalMedia").when(s % 3 == 1, "ProxyPreview"),
        "sample_start": first(c("frame")), "sample_end": first(c("frame") + 1),
        "prepared_frames": F.when(c("armed"), F.greatest(F.least(left, F.lit(8)), F.lit(0))).otherwise(0),
        "video_payload_ready": c("armed") & (left >= 3), "audio_payload_ready": c("armed") & (c("rate_num") > 0),
        **{f"{n}_verified": s % k == 0 for n, k in (("visual", 5), ("realtime", 7), ("audio_device", 11), ("av_sync", 13))}})


@query("p16_passive_view", ["ranged_log", "clip"], FACTS + """
, h as (select *, private_path_exposed or proxy_aac_authoritative as hidden, loaded and frame is not null and rate_num > 0 as confirmed,
    loaded and audio_authority = 'Original' as original from snap)
select session_id, seq,
  case when hidden then 'empty' when visual_verified and frame is not null then 'picture' when loaded then 'status:' || status else 'empty' end as monitor,
  case when not hidden and visual_verified then frame end as monitor_frame,
  case when hidden then 0 when loaded and has_range and range_start < range_end then range_start else 0 end as timeline_start,
  case when hidden then 0 when loaded and has_range and range_start < range_end then range_end - range_start when loaded then 1 else 0 end as timeline_frames,
  case when not hidden and loaded then frame end as playhead, not hidden and confirmed as cue_enabled,
  case when not hidden and original then 'original' else 'none' end as wave,
  case when hidden or not original then '' else array_to_string(list_transform(range(0, lane_count),
    lambda x: 'A' || (x + 1) || ':' || (x // 2) || '.' || (x % 2)), ',') end as lanes,
  case when not hidden and original then sample_start end as sample_start, case when not hidden and original then sample_end end as sample_end,
  case when hidden then 'Empty' else status end as transport, case when not hidden and loaded then public_uri end as public_uri,
  case when hidden or not loaded then 'none' when source_mode = 'OriginalMedia' then 'original' when source_mode = 'ProxyPreview' then 'proxy'
    else 'none' end as picture,
  case when hidden or not loaded then 'none' else audio_authority end as audio,
  not hidden and transport_ready and confirmed as play_enabled, not hidden and status = 'Playing' as pause_enabled,
  not hidden and loaded as source_loaded, case when hidden then 0 else prepared_frames end as prepared_frames,
  not hidden and video_payload_ready as video_payload_ready, not hidden and audio_payload_ready as audio_payload_ready,
  not hidden and visual_verified and frame is not null as presented, case when not hidden then reason end as last_rejection,
  not hidden and realtime_verified as realtime_verified, not hidden and visual_verified as visual_verified,
  not hidden and audio_device_verified as audio_device_verified, not hidden and av_sync_verified as av_sync_verified from h""", recursive=True)
def p16(command_log, clip):
    lane = lambda x: F.concat(x["label"], F.lit(":"), x["source_track_index"], F.lit("."), x["source_channel_index"])
    seen = pl.passive_view(facts(_replayed(command_log), clip))
    return seen.withColumn("lanes", F.array_join(F.transform("lanes", lane), ","))


@query("p17_client_predicates", ["ranged_log", "clip"], FACTS + """
, h as (select *, loaded and frame is not null and has_range and range_start < range_end and rate_num > 0 and not private_path_exposed and not proxy_aac_authoritative as ok from snap)
select session_id, seq, ok as confirmed_position, ok and transport_ready as ready, ok and transport_ready as can_start, status = 'Playing' as playing,
  case when ok then cast(40000000 as bigint) end as interval_ns, reason as error from h""", recursive=True)
def p17(command_log, clip):
    return pl.client_predicates(facts(_replayed(command_log), clip))


WINDOWS = """, w as (select session_id, seq, frame, case when greatest(frame - 2, range_start) <= least(frame + 5, range_end - 1)
    then range(greatest(frame - 2, range_start), least(frame + 5, range_end - 1) + 1)[1:8] else [] end as win from ranged_log),
l as (select *, coalesce(lag(win) over (partition by session_id order by seq), []) as before from w)"""


@query("s1_prepared_window", ["ranged_log"], WINDOWS + """
select session_id, seq, frame, array_to_string(list_sort(list_filter(win, lambda x: not list_contains(before, x))), ',') as added,
  array_to_string(list_sort(list_filter(win, lambda x: list_contains(before, x))), ',') as kept,
  array_to_string(list_sort(list_filter(before, lambda x: not list_contains(win, x))), ',') as discarded from l""", settle=["ranged_log"])
def s1(command_log):
    text = lambda n: F.array_join(F.sort_array(n), ",").alias(n)
    return pl.prepared_window(command_log).select(
        "session_id", "seq", "frame", text("added"), text("kept"), text("discarded"))


@query("s2_window_health", ["ranged_log"], WINDOWS + """
select session_id, seq, case when len(before) = 0 then 'Empty' when not list_contains(before, frame) then 'Underrun'
  when len(list_filter(before, lambda x: x >= frame)) < 3 then 'LowWater' else 'Ok' end as health from l""", settle=["ranged_log"])
def s2(command_log):
    return pl.window_health(pl.prepared_window(command_log), 3)


@query("k4_run_cap", ["ranged_log"], """
, t as (select session_id, seq, frame, row_number() over w as tick, sum(case when frame >= range_end then 1 else 0 end) over w as past
  from ranged_log where command = 'Play' window w as (partition by session_id order by seq rows unbounded preceding))
select session_id, seq, frame, tick from t where tick <= 5 and past = 0""", settle=["ranged_log"])
def k4(command_log):
    return pl.run_cap(command_log.where("command = 'Play'").select("session_id", "seq", "frame", "range_end"), 5).select("session_id", "seq", "frame", "tick")


@query("k3_ordered_tracks", ["packet"], """
select clip_id, channel, count(*) as packets from packet where essence_key like 'pcm.%' group by all order by clip_id, channel""")
def k3(packet):
    return packet.where(c("essence_key").startswith("pcm.")).groupBy("clip_id", "channel").agg(
        F.count("*").alias("packets")).orderBy("clip_id", "channel")
