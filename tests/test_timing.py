"""Frame and sample arithmetic against published values and against Python's exact rationals."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cliptide.functions import timing as t

c = F.col


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame(
        [(1, 50, 1, 106, 48000), (2, 30000, 1001, 120, 48000), (3, 60000, 1001, 90, 44100), (4, 24, 1, 0, 48000)],
        "clip_id bigint, rate_num int, rate_den int, duration_frames bigint, sample_rate int")


def test_frames_and_samples_are_exact(clips):
    rates = {1: (50, 1, 48000), 2: (30000, 1001, 48000), 3: (60000, 1001, 44100)}
    rows = t.frame_timeline(clips).collect()
    assert len(rows) == 316
    for r in rows:
        n, d, _ = rates[r.clip_id]
        assert r.offset_ns == int(Fraction(r.frame * d * 10**9, n))
    for r in t.frame_samples(clips).collect():
        n, d, sr = rates[r.clip_id]
        assert r.start_sample == int(Fraction(r.frame * sr * d, n)) and r.end_sample == int(Fraction((r.frame + 1) * sr * d, n))


def test_published_boundaries(clips):
    frames = {r.frame: (r.start_sample, r.end_sample) for r in t.frame_samples(clips.where("clip_id = 1")).collect()}
    assert frames[0] == (0, 960) and frames[1] == (960, 1920) and frames[49] == (47040, 48000)


def test_fractional_rate_alternates(clips):
    counts = {r.end_sample - r.start_sample for r in t.frame_samples(clips.where("clip_id = 2")).collect()}
    assert counts == {1601, 1602}


def test_large_positions_stay_exact(spark):
    frame = 4_000_000_000
    row = spark.range(1).select(t.offset_ns(F.lit(frame), F.lit(60000), F.lit(1001)).alias("x")).first()
    assert row.x == frame * 1001 * 10**9 // 60000


def test_interval_rounds_up(spark):
    df = spark.createDataFrame([(25, 1), (30000, 1001), (0, 1), (24, 0)], "n int, d int")
    assert [r.x for r in df.select(t.interval_ns(c("n"), c("d")).alias("x")).collect()] == [40_000_000, 33_366_667, None, None]


def test_latest_due_and_drain(spark):
    base = spark.createDataFrame([(0, 50, 50, 1)], "range_start bigint, range_end bigint, rate_num int, rate_den int")
    due = lambda ms: base.select(t.due_frame(F.lit(ms), c("range_start"), c("range_end"), c("rate_num"), c("rate_den")).alias("x")).first().x
    assert [due(0), due(60), due(1000)] == [0, 3, 49]

    def drain(mode, last, now):
        ticks = base.withColumns({"mode": F.lit(mode), "last_ms": F.lit(last).cast("int"), "now_ms": F.lit(now)})
        return sorted(r.frame for r in t.due_drain(ticks).collect())

    assert drain("forward", None, 60) == [0, 1, 2, 3]
    assert drain("forward", 60, 100) == [4, 5]
    assert drain("still", None, 60) == []
    assert drain("reverse", None, 40) == [47, 48, 49]
    assert drain("double", None, 60) == [0, 1, 2, 3, 4, 5, 6]
    assert drain("forward", 900, 5000) == [46, 47, 48, 49]
    assert drain("forward", 1000, 5000) == []


def test_media_time(spark):
    df = spark.createDataFrame([(10,), (250,), (180_000 * 50,)], "f bigint")
    got = [r.x for r in df.select(t.media_time_text(c("f"), F.lit(50), F.lit(1)).alias("x")).collect()]
    assert got == ["00:00:00.200", "00:00:05.000", "50:00:00.000"]


def test_rates(spark):
    df = spark.createDataFrame([(25, 1, 50, 2), (25, 1, 25, 1), (30000, 1001, 30, 1)], "a int, b int, x int, y int")
    parts = [c(n) for n in "abxy"]
    assert [r.e for r in df.select(t.rates_equal(*parts).alias("e")).collect()] == [True, True, False]
    assert [r.e for r in df.select(t.rates_equal(*parts, strict=True).alias("e")).collect()] == [False, True, False]


def test_ranges_open_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(t, "EXPLODE_STEP", 10)
    df = spark.createDataFrame([(1, 3, 37), (2, 5, 5), (3, 9, 2)], "k bigint, a bigint, b bigint")
    got = sorted((r.k, r.x) for r in t.explode_range(df, "a", "b", "x").collect())
    assert got == [(1, i) for i in range(3, 37)]
