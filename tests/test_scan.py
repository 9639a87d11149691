"""Chunked scans and joins against the plain definitions, with chunks small enough to be crossed often."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cliptide.operators.interval import overlap_counts
from cliptide.operators import audio as au
from cliptide.operators import capability as cap
from cliptide.operators import playout as po
from cliptide.operators import index as ix
from cliptide.operators.interval import asof_backward, interval_join
from cliptide.operators.scan import div, ordered_scan


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    # One key holds most rows; positions have holes; values are often null.
    data = [
        (0 if rng.random() < 0.6 else rng.randrange(1, 6), pos, rng.choice([None, None, rng.randrange(100)]))
        for pos in rng.sample(range(3000), 700)
    ]
    return spark.createDataFrame(data, "k bigint, pos bigint, v bigint").cache()


@pytest.mark.parametrize("width", [1, 7, 64, 100000])
def test_ordered_scan_equals_windows(log, width):
    w = Window.partitionBy("k").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = log.select(
        "k", "pos", F.row_number().over(w), F.sum(F.coalesce("v", F.lit(0))).over(upto), F.lag("v").over(w),
        F.last("v", ignorenulls=True).over(upto),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max("v").over(upto))
    got = ordered_scan(
        log, ["k"], ["pos"], div("pos", width), rank="rank", sums={"total": F.coalesce("v", F.lit(0))},
        lags={"before": F.col("v")}, lasts={"seen": F.col("v")}, befores={"earlier": F.col("v")}, maxes={"top": F.col("v")})
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.select("k", "pos", "rank", "total", "before", "seen", "earlier", "top").collect()), key=key) == \
        sorted(map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_asof_equals_theta_join(spark, width):
    rng = random.Random(3)
    points = spark.createDataFrame(
        sorted({(rng.randrange(4), rng.randrange(60)) for _ in range(80)}), "clip_id bigint, p bigint")
    asked = spark.createDataFrame([(i, rng.randrange(5), rng.randrange(60)) for i in range(300)], "rid bigint, clip_id bigint, at bigint")
    naive = asked.join(points, (asked.clip_id == points.clip_id) & (points.p <= asked["at"]), "left").groupBy(
        asked.rid).agg(F.max("p").alias("p"))
    got = asof_backward(asked, points, ["clip_id"], "at", "rid", "p", width)
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select("rid", "p").collect()), key=key) == sorted(map(tuple, naive.collect()), key=key)


@pytest.mark.parametrize("width", [1, 8, 10000])
def test_interval_join_equals_theta_join(spark, width):
    rng = random.Random(5)
    span = lambda n: (lambda s: (s, s + rng.randrange(0, n)))(rng.randrange(200))
    a = spark.createDataFrame([(i, rng.randrange(3), *span(40)) for i in range(60)], "a bigint, k bigint, s bigint, e bigint")
    b = spark.createDataFrame([(i, rng.randrange(3), *span(9)) for i in range(90)], "b bigint, k bigint, ps bigint, pe bigint")
    naive = a.join(b, (a.k == b.k) & (b.pe > a.s) & (b.ps < a.e) & (a.s < a.e) & (b.ps < b.pe))
    got = interval_join(a, b, ["k"], ("s", "e"), ("ps", "pe"), width)
    assert rows_of(got, "a", "b") == rows_of(naive, "a", "b")
    assert got.count() > 0


@pytest.mark.parametrize("width", [4, 16, 1000])
def test_loudest_range_equals_sliding_sum(spark, width):
    rng = random.Random(11)
    data = [(t, b * 3, p, rng.randrange(-5000, 5000)) for t in range(3) for b in range(50) for p in range(4)]
    samples = spark.createDataFrame(data, "track_id int, block_no bigint, pos int, s24 int")
    want = {}
    for t in range(3):
        energy = [sum(s * s for tt, b, _, s in data if tt == t and b == k * 3) for k in range(50)]
        sums = [sum(energy[i : i + 5]) for i in range(46)]
        want[t] = sums.index(max(sums)) * 3
    got = {r.track_id: r.start_block for r in au.loudest_range(samples, 5, width).collect()}
    assert got == want


def test_loudest_range_takes_the_earliest_of_equals(spark):
    data = [(1, b, 0, 100) for b in range(20)]
    samples = spark.createDataFrame(data, "track_id int, block_no bigint, pos int, s24 int")
    assert au.loudest_range(samples, 3, 4).first().start_block == 0


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    data = [(r, f, round(rng.expovariate(0.05), 3)) for r in range(4) for f in range(101 + r)]
    got = {r.run_id: r for r in po.lateness_distribution(
        spark.createDataFrame(data, "run_id bigint, frame bigint, lateness_ms double"), 2000).collect()}
    for run in range(4):
        values = [v for r, _, v in data if r == run]
        assert got[run].median_ms == pytest.approx(np.percentile(values, 50), abs=1e-6)
        assert got[run].p90_ms == pytest.approx(np.percentile(values, 90), abs=1e-6)
        assert got[run].max_ms == max(values)


def test_capability_staircase_equals_all_pairs(spark):
    rng = random.Random(9)
    caps = [(i, rng.choice("ab"), 8, "4:2:0", rng.randrange(1, 40) * 100, rng.randrange(1, 40) * 60,
             rng.choice(["hardware", "software"]), rng.random() < 0.8, rng.choice(["H264", "H265"]), rng.random() < 0.4) for i in range(120)]
    asked = [(i, rng.choice("abc"), 8, "4:2:0", rng.randrange(1, 4200), rng.randrange(1, 2500), rng.choice(["H264", "H265", "AV1"]),
              rng.choice(["progressive", "interlaced"])) for i in range(400)]
    formats = [(i, 8, "4:2:0") for i in range(120) if i % 5]
    got = {r.request_id: r.backend for r in cap.match_requests(
        spark.createDataFrame(asked, "request_id bigint, profile string, bit_depth int, chroma string, width int, height int, codec string, scan string"),
        spark.createDataFrame(caps, "capability_id bigint, profile string, bit_depth int, chroma string, max_width int, "
                                    "max_height int, backend string, progressive boolean, codec string, interlaced boolean"),
        spark.createDataFrame(formats, "capability_id bigint, bit_depth int, chroma string")).collect()}

    def naive(r):
        fit = {c[6] for c in caps if c[0] % 5 and c[7 if r[7] == "progressive" else 9] and c[8] == r[6] and c[1] == r[1]
               and r[4] <= c[4] and r[5] <= c[5]}
        return "hardware" if "hardware" in fit else "software" if "software" in fit else "unsupported"

    assert got == {r[0]: naive(r) for r in asked}
    assert len(set(got.values())) == 3


def test_index_of_the_short_camera_clip(spark):
    # 106 packets of 2880 bytes on each of four tracks: 960 samples each, 101,760 in all.
    packets = spark.createDataFrame(
        [(1, ch, f"pcm.{ch}", 4 * i + ch + 1, 2880, 24, (4 * i + ch) * 2900) for i in range(106) for ch in range(4)],
        "clip_id bigint, channel int, essence_key string, packet_no bigint, payload_len bigint, bit_depth int, file_offset bigint")
    index = ix.packet_index(packets, 10).cache()
    assert index.where("channel = 2 and edit_unit = 49").select("start_sample", "end_sample").first() == (47040, 48000)
    assert ix.clip_samples(index).select("total_samples", "channels").first() == (101760, 4)
    whole = ix.corpus_summary(index).where("level = 3").first()
    assert (whole.tracks, whole.packets, whole.bytes, whole.seconds) == (4, 424, 424 * 2880, 8.48)
    audit = ix.gap_totals(ix.gap_audit(index.withColumn("copy", F.lit(0)), 3000)).collect()
    assert all(r.monotonic and r.gap_blocks == 0 and r.overlap_blocks == 0 for r in audit)


def test_index_only_reads_no_payload(spark):
    from cliptide.sources import view
    plan = view(spark, "/root/testdata/sf0.001", "pcm_block").select("track_id", "block_no")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_overlap_counts_equal_all_pairs(spark):
    rng = random.Random(12)
    ranges = [(rng.randrange(3), a, a + rng.randrange(0, 30)) for a in (rng.randrange(0, 300) for _ in range(150))]
    asked = [(i, rng.randrange(4), a, a + rng.randrange(-2, 40)) for i, a in enumerate(rng.randrange(0, 330) for _ in range(200))]
    got = {r.i: r.n for r in overlap_counts(
        spark.createDataFrame(asked, "i bigint, k int, a bigint, b bigint"), spark.createDataFrame(ranges, "k int, s bigint, e bigint"),
        ["k"], "a", "b", "s", "e", "n", 50).collect()}
    assert got == {i: sum(k == q and e > a and s < b for q, s, e in ranges) if a < b else 0 for i, k, a, b in asked}
