"""Micro-batches of a replay grow with the number of sessions, so that a row pays for a fixed number of states."""

import random

import pytest

from cliptide.operators import player as pl
from cliptide.plans import stream_queries as queries
from cliptide.streaming import source as src
from cliptide.streaming import stateful
from test_replay import random_log
from test_streams import timed


def many_sessions(spark):
    return timed(spark, [(s, *r[1:]) for s in range(150) for r in random_log(random.Random(s), 1, 8, 0.5)])


@pytest.fixture
def batches(monkeypatch):
    """Batches with rows, of every stream that the test drains."""
    kept = []
    replay = queries.replay_stream

    def counted(stream, *args, **more):
        src.run_batches(stream.sparkSession, stream, "batches", lambda b, _: kept.append(b.where("seq is not null").count()))
        return replay(stream, *args, **more)

    monkeypatch.setattr(queries, "replay_stream", counted)
    return kept


def test_a_log_of_many_sessions_is_replayed_in_few_batches(spark, monkeypatch, batches):
    monkeypatch.setattr(src, "ROWS_PER_FILE", 50)
    log = many_sessions(spark)
    rows = log.count()
    got = queries.st1(log.withColumn("command_id", log.seq * 7))
    assert sum(batches) == rows
    assert len(batches) <= rows // (stateful.ROWS_PER_KEY * 150) + 6 < rows // 50
    assert got.where("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, pl.replay(log.drop("ts")).collect()))


def test_files_of_a_batch_follow_the_keys_and_the_largest_key(spark, monkeypatch):
    keys = lambda n, hot: spark.range(n + hot).selectExpr(f"case when id < {n} then id else 0 end as session_id")
    monkeypatch.setattr(src, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(stateful, "ROWS_SIDE_BY_SIDE", 500)
    assert stateful.sizes_for(keys(20, 0)) == (stateful.LEAST_BUCKETS, 1)
    assert stateful.sizes_for(keys(1000, 0))[1] == 10 * stateful.ROWS_PER_KEY
    # Half of all rows: 500 of one session are in 1,000 rows, ten files.
    assert stateful.sizes_for(keys(2000, 1999))[1] == 9
    assert stateful.sizes_for(keys(1000, 100_000))[1] == 5
    assert stateful.sizes_for(keys(0, 0)) == (stateful.LEAST_BUCKETS, 1)
