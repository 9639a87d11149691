"""Sinks and streams. Each stages its log from the driver tables, drains the stream, and returns what
the stream wrote; the DuckDB side is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import machines
from ..sources import sinks
from ..sources.tables import fresh_path
from ..streaming import source as src
from ..streaming import windows as win
from ..streaming.stateful import replay_stream, sizes_for
from .registry import query
from .session_queries import REPLAY, targets
from .snippets import EXPOSED

c = F.col
SLICES = 4


def _stream(waves, order=("ts", "seq"), files=SLICES, ts="ts", per_batch=1):
    """A log, or waves of one, as a stream that takes ``per_batch`` files per micro-batch."""
    waves = waves if isinstance(waves, list) else [waves]
    spark, schema = waves[0].sparkSession, waves[0].schema
    return src.open_stream(spark, src.land(waves, fresh_path(spark, "landed"), order, files), schema, ts, per_batch)


def _heartbeat(log):
    """One row far after the last, so that the watermark passes every window of the log."""
    last = log.agg(F.max("ts").alias("ts")).select((c("ts") + F.expr("interval 60 days")).alias("ts"))
    return last.select(*[(c("ts") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in log.schema.fields])


@query("snk1_public_manifest", ["prepared"], f"""
select clip_id, public_uri, width, height, duration_frames,
  sha256(concat_ws('|', public_uri, width, height, duration_frames, rate_num, rate_den)) as checksum
from prepared where not ({EXPOSED})""")
def snk1(prepared):
    spark = prepared.sparkSession
    path = fresh_path(spark, "manifest")
    sinks.write_manifest(prepared, path)
    return sinks.read_manifest(spark, path)


@query("src4_event_stream", ["command_log"], "select command, count(*) as commands from command_log group by command")
def src4(command_log):
    return src.run_to_table(command_log.sparkSession, _stream(command_log).select("command_id", "command"), "events").groupBy("command").agg(
        F.count("*").alias("commands"))


@query("snk2_transcript", ["command_log"], "select session_id, seq, command_id, command from command_log")
def snk2(command_log):
    return src.run_to_table(command_log.sparkSession, _stream(command_log).select("session_id", "seq", "command_id", "command"), "transcript")


@query("st1_streaming_replay", ["ranged_log"], REPLAY + """
select session_id, false as late, seq, command, accepted, reason, status, loaded, has_range, frame, armed, generation, range_start, range_end from replayed""", recursive=True, settle=["ranged_log"])
def st1(command_log):
    buckets, per_batch = sizes_for(command_log)
    stream = _stream([targets(command_log), _heartbeat(command_log)], per_batch=per_batch)
    return src.run_to_table(command_log.sparkSession, replay_stream(stream, machines.player(), buckets=buckets), "replay")


@query("st2_streaming_dedup", ["command_log"], "select distinct session_id, command_id from command_log")
def st2(command_log):
    # Planted: one command in seven arrives again, two weeks after its time.
    sent = command_log.withColumn("arrival", c("ts"))
    again = sent.where("command_id % 7 = 0").withColumn("arrival", c("ts") + F.expr("interval 14 days"))
    stream = _stream(sent.unionByName(again), ("arrival", "ts", "seq"))
    return src.run_to_table(
        command_log.sparkSession, win.drop_repeated(stream, ["session_id", "command_id"], "ts", "20 days"), "commands"
    ).select("session_id", "command_id")


@query("st3_streaming_coverage", ["command_log"], """
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
select session_id, seq, label, covered_until, submissions from st where seq > 0""", recursive=True, settle=["command_log"])
def st3(command_log):
    buckets, per_batch = sizes_for(command_log)
    log = _stream([command_log, _heartbeat(command_log)], per_batch=per_batch)
    ticks = log.withColumn("op", F.when(c("command").isin("Seek", "Stop"), "reset").otherwise("tick"))
    return src.run_to_table(command_log.sparkSession, replay_stream(ticks, machines.coverage(), buckets=buckets), "coverage").drop("late")


SLICED = """, b as (select min(epoch_ms(ts) // 1000) as low, max(epoch_ms(ts) // 1000) as high from events),
s as (select e.*, (epoch_ms(ts) // 1000 - low) // ((high - low) // 4 + 1) as slice from events e, b)"""


@query("st4_late_accounting", ["events"], SLICED + """
select count(*) as arrived, count(*) filter (slice <> 1) as counted, count(*) filter (slice = 1) as late,
  count(*) filter (slice <> 1 and value <= 5) as on_time, count(*) filter (slice <> 1 and value > 40) as dropped from s""")
def st4(events):
    """A quarter of the time span is held back until the watermark has passed it: none of its rows may vanish unseen."""
    seconds = c("ts").cast("timestamp").cast("long")
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    held = F.coalesce(F.floor((seconds - low) / ((high - low) // SLICES + 1)) == 1, F.lit(False)) if low is not None else F.lit(False)
    stream = _stream([events.where(~held), events.where(held), _heartbeat(events)], ("ts", "event_id"))
    spark = events.sparkSession
    counted = win.accounted_counters(stream, "ts", 86_400, "1 hour", {
        "counted": c("event_id").isNotNull(), "on_time": c("value") <= 5, "dropped": c("value") > 40}, ["event_id"])
    told = src.run_to_table(spark, counted, "accounted")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    late = F.count_if(c("kind").isin("late", "untimed"))
    return told.agg((late + F.coalesce(F.sum("counted"), F.lit(0))).alias("arrived"), total("counted"), late.alias("late"), total("on_time"), total("dropped"))


@query("st5_live_status", ["command_log"], """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as commands, count(*) filter (command = 'Play') as plays,
  count(*) filter (expected_generation is not null) as checked from command_log group by 1""")
def st5(command_log):
    wins = win.live_counters(_stream([command_log, _heartbeat(command_log)]), "ts", "1 day", "1 hour", {
        "commands": c("command_id").isNotNull(), "plays": c("command") == "Play", "checked": c("expected_generation").isNotNull()})
    return src.run_to_table(command_log.sparkSession, wins, "status").select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "commands", "plays", "checked")


@query("st6_latest_snapshot", ["command_log"], """
select session_id, seq, command, frame from (select *, row_number() over (partition by session_id order by seq desc) as place from command_log) x
where place = 1""")
def st6(command_log):
    spark = command_log.sparkSession
    stream = _stream(command_log).select("session_id", "seq", "command", "frame")
    table = sinks.SnapshotTable(fresh_path(spark, "snapshots"), "session_id", "seq", "session_id bigint, seq bigint, command string, frame bigint")
    last = src.run_batches(spark, stream, "snapshots", table.upsert)
    return table.read(spark, last)
