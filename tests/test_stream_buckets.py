"""Sessions that share buckets of state are replayed as if each were alone, at one call a bucket and batch."""

import random

from pyspark.sql import functions as F

from cliptide.operators import machines
from cliptide.operators import player as pl
from cliptide.streaming import source as src
from cliptide.streaming import stateful
from cliptide.streaming.stateful import replay_stream
from test_replay import random_log
from test_streams import beat, stream_of, timed


def test_sessions_of_a_bucket_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(src, "ROWS_PER_FILE", 700)
    rows = [(s, *r[1:]) for s in range(60) for r in random_log(random.Random(s), 1, 30, 0.5)]
    log = timed(spark, rows)
    stream = replay_stream(stream_of(spark, [log]), machines.player(), buckets=3)
    got = src.run_to_table(spark, stream, "replay")
    assert got.where("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, pl.replay(log.drop("ts")).collect()))


def test_a_gap_holds_its_own_session_only(spark):
    script = ["LoadPreparedInput", "Prepare", "Cue", "Play", "Pause", "Play"]
    log = timed(spark, [(s, i + 1, c, 5, None, None, 0, 50) for s in (1, 2, 3) for i, c in enumerate(script)])
    held = (F.col("seq") == 4) & (F.col("session_id") == 2)
    first = stream_of(spark, [log.where(~held)], files=1)
    got = src.run_to_table(spark, replay_stream(first, machines.player(), buckets=1), "replay")
    assert sorted((r.session_id, r.seq) for r in got.collect()) == [(s, i) for s in (1, 2, 3) for i in range(1, 7) if s != 2 or i < 4]
    stream = stream_of(spark, [log.where(~held), beat(log), log.where(held)], files=1)
    got = src.run_to_table(spark, replay_stream(stream, machines.player(), bound="1 minute", buckets=1), "replay")
    assert sorted((r.session_id, r.seq) for r in got.where("not late").collect()) == [(s, i) for s in (1, 2, 3) for i in range(1, 7) if (s, i) != (2, 4)]
    assert [(r.session_id, r.seq) for r in got.where("late").collect()] == [(2, 4)]


def test_buckets_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(stateful, "KEYS_PER_BUCKET", 10)
    assert stateful.buckets_for(spark.range(20).withColumnRenamed("id", "session_id")) == stateful.LEAST_BUCKETS
    assert 150 < stateful.buckets_for(spark.range(2000).withColumnRenamed("id", "session_id")) < 250
