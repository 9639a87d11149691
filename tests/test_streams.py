"""Streams over empty logs, bursts, hot sessions in small batches, rows out of order, late rows and replayed batches."""

import random

from pyspark.sql import functions as F

from cliptide.operators import machines
from cliptide.operators import player as pl
from cliptide.sources import sinks
from cliptide.sources.tables import fresh_path
from cliptide.streaming import source as src
from cliptide.streaming import windows as win
from cliptide.streaming.stateful import replay_stream
from test_replay import LOG, random_log


def stream_of(spark, waves, order=("ts", "seq"), files=2):
    return src.open_stream(spark, src.land(waves, fresh_path(spark, "landed"), order, files), waves[0].schema, "ts")


def timed(spark, rows, seconds=60):
    return spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds(F.col("seq") * seconds).cast("timestamp_ntz"))


def beat(log):
    last = log.agg((F.max("ts") + F.expr("interval 9 days")).alias("ts"))
    return last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields])


def batches_of(spark, stream):
    sizes = []
    src.run_batches(spark, stream, "sizes", lambda b, _: sizes.append(b.count()))
    return sizes


def test_hot_session_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(src, "ROWS_PER_FILE", 40)
    rows = random_log(random.Random(6), 3, 120, 0.7)
    log = timed(spark, rows)
    sizes = batches_of(spark, stream_of(spark, [log]))
    assert sum(sizes) == len(rows) and max(sizes) <= 40 and len(sizes) >= len(rows) // 40
    got = src.run_to_table(spark, replay_stream(stream_of(spark, [log]), machines.player()), "replay")
    assert got.where("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, pl.replay(log.drop("ts")).collect()))


def test_rows_out_of_order_within_the_bound_are_replayed(spark, monkeypatch):
    monkeypatch.setattr(src, "ROWS_PER_FILE", 25)
    rows = random_log(random.Random(8), 2, 200, 0.9)
    rng = random.Random(1)
    log = timed(spark, rows)
    # Arrival differs from the row's time by up to eight minutes either way.
    arrived = log.join(spark.createDataFrame([(r[0], r[1], r[1] * 60 + rng.randrange(-480, 480)) for r in rows], "session_id bigint, seq bigint, arrival bigint"), ["session_id", "seq"])
    stream = stream_of(spark, [arrived], ("arrival",))
    got = src.run_to_table(spark, replay_stream(stream, machines.player(), bound="30 minutes"), "replay")
    assert got.where("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, pl.replay(log.drop("ts")).collect()))


def test_a_missing_row_holds_the_rest_until_the_watermark_and_is_late_then(spark):
    script = ["LoadPreparedInput", "Prepare", "Cue", "Play", "Pause", "Play"]
    rows = [(1, i + 1, c, 5, None, None, 0, 50) for i, c in enumerate(script)]
    log = timed(spark, rows)
    held = log.where("seq = 4")  # comes when the watermark has passed all
    stream = stream_of(spark, [log.where("seq <> 4"), beat(log), held], files=1)
    got = {(r.seq, r.late): r for r in src.run_to_table(spark, replay_stream(stream, machines.player(), bound="1 minute"), "replay").collect()}
    assert set(got) == {(1, False), (2, False), (3, False), (5, False), (6, False), (4, True)}
    assert got[5, False].reason == "IllegalCommandForState" and got[6, False].status == "Playing" and got[4, True].status is None


def test_repeated_and_untimed_rows(spark):
    script = ["LoadPreparedInput", "Prepare", "Cue", "Play"]
    log = timed(spark, [(1, i + 1, c, 5, None, None, 0, 50) for i, c in enumerate(script)])
    untimed = log.where("seq = 3").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    stream = stream_of(spark, [log.where("seq <> 3"), untimed, log.where("seq = 2"), beat(log)], files=1)
    got = sorted((r.seq, r.late, r.status) for r in src.run_to_table(spark, replay_stream(stream, machines.player()), "replay").collect())
    assert got == [(1, False, "Loaded"), (2, False, "Loaded"), (2, True, None), (3, False, "Ready"), (4, False, "Playing")]


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert src.run_to_table(spark, replay_stream(stream_of(spark, [log]), machines.player()), "replay").count() == 0
    table = sinks.SnapshotTable(fresh_path(spark, "snap"), "session_id", "seq", "session_id bigint, seq bigint, frame bigint")
    last = src.run_batches(spark, stream_of(spark, [log]).select("session_id", "seq", "frame"), "snap", table.upsert)
    assert table.read(spark, last).count() == 0


def test_a_burst_is_cut_into_files_in_order_and_rows_without_time_stay(spark, monkeypatch):
    monkeypatch.setattr(src, "ROWS_PER_FILE", 40)
    # 900 rows within one second, a few spread over a month, some without time.
    rows = [(i, 86_400_000_000) for i in range(900)] + [(1000 + i, i * 86_400_000_000) for i in range(30)] + [(2000 + i, None) for i in range(70)]
    log = spark.createDataFrame(rows, "n long, t long").select("n", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))
    got = []
    src.run_batches(spark, stream_of(spark, [log.repartition(7)], ("ts", "n"), 4), "order", lambda b, _: got.append([(r.n, r.ts) for r in b.select("n", "ts").collect()]))
    assert max(map(len, got)) <= 40 and sorted(n for g in got for n, _ in g) == sorted(n for n, _ in rows)
    flat = [(ts is None, ts, n) for g in got for n, ts in sorted(g, key=lambda x: (x[1] is None, x[1] or 0, x[0]) if x[1] is None else (False, x[1], x[0]))]
    keys = [(none, str(ts), n) for none, ts, n in flat]
    assert keys == sorted(keys)


def test_late_rows_are_labelled_and_kept(spark):
    rows = [(i, i * 3600, float(i % 7)) for i in range(24 * 6)]
    log = spark.createDataFrame(rows, "event_id long, s long, value double").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value")
    held = (F.col("event_id") >= 24) & (F.col("event_id") < 30)
    untimed = log.where("event_id = 3").select(F.lit(999).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "value")
    stream = stream_of(spark, [log.where(~held), untimed, log.where(held), beat(log)], ("ts", "event_id"), 1)
    out = src.run_to_table(spark, win.accounted_counters(
        stream, "ts", 86_400, "1 hour", {"counted": F.col("event_id").isNotNull(), "small": F.col("value") < 3}, ["event_id"]), "counted")
    assert sorted((r.kind, r.event_id) for r in out.where("kind <> 'window'").collect()) == [("late", k) for k in range(24, 30)] + [("untimed", 999)]
    per = {r.start_ms // 86_400_000: (r.n, r.s) for r in out.where("kind = 'window'").groupBy("start_ms").agg(F.sum("counted").alias("n"), F.sum("small").alias("s")).collect()}
    want = {}
    for i, _, value in rows:
        if not 24 <= i < 30:
            n, s = want.get(i // 24, (0, 0))
            want[i // 24] = (n + 1, s + (value < 3))
    assert per == want


def size_of(path):
    from pathlib import Path
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_upserts_write_what_their_batch_holds_and_can_be_run_again(spark):
    rng, newest, path = random.Random(5), {}, fresh_path(spark, "lsm")
    schema = "k bigint, seq bigint, v string"
    table = sinks.SnapshotTable(path, "k", "seq", schema)
    seq, plain = 0, []
    for batch in range(19):
        rows = []
        for _ in range(2000 if batch == 0 else 5):
            seq += 1
            rows.append((len(rows) if batch == 0 else rng.randrange(3000), seq, f"value {seq} " * 3))
        df = spark.createDataFrame(rows, schema).coalesce(1)
        before = size_of(path)
        table.upsert(df, batch)
        if batch % 5 == 3:  # a batch that is run again
            table.upsert(df, batch)
        plain.append(size_of(path) - before)
        newest.update({k: (s, v) for k, s, v in rows})
        assert len(table.runs(batch)) <= 2 * (table.FAN_OUT - 1)
    assert {r.k: (r.seq, r.v) for r in table.read(spark, 18).collect()} == newest
    assert max(p for i, p in enumerate(plain) if i % table.FAN_OUT != table.FAN_OUT - 1 and i) < plain[0] / 5
    assert table.runs(18) == [f"{path}/1-0", f"{path}/1-1", f"{path}/0-16", f"{path}/0-17", f"{path}/0-18"]
    assert table.read(spark, 0).count() == 2000  # an earlier version is still whole


def test_whole_numbers_stay_whole_beside_nulls_of_other_keys():
    """A batch with a null anywhere comes as floats; a key without nulls must still see whole numbers."""
    import pandas as pd

    from cliptide.streaming.stateful import plain_column

    batch = pd.Series([47.0, 12.0, None])
    assert [type(x) for x in plain_column(batch[:2], True)] == [int, int] and plain_column(batch, True) == [47, 12, None]
    assert plain_column(pd.Series([None, None], dtype=object), True) == [None, None]
