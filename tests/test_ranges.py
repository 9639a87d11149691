"""Interval measures, the dyadic join and the stored index against the plain definitions, and what their plans touch."""

import random

import pytest
from pyspark.sql import functions as F

from cliptide.operators import audio as au
from cliptide.operators import index as ix
from cliptide.operators.interval import covered_measure, dyadic_cover, interval_join
from cliptide.sources.tables import fresh_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 13, 100000])
def test_measure_of_a_union_equals_counting(spark, width):
    rng = random.Random(17)
    spans = [(k, a, a + rng.randrange(-1, 25)) for k in range(3) for a in (rng.randrange(-40, 300) for _ in range(25 * k + 3))]
    asked = [(i, rng.randrange(4), a, a + rng.randrange(-3, 60)) for i, a in enumerate(rng.randrange(-60, 330) for _ in range(300))]
    held = {k: {x for q, s, e in spans if q == k for x in range(s, e)} for k in range(4)}
    got = covered_measure(
        spark.createDataFrame(asked, "i bigint, k int, a bigint, b bigint"), spark.createDataFrame(spans, "k int, s bigint, e bigint"),
        ["k"], ("a", "b"), ("s", "e"), "n", width)
    assert {r.i: r.n for r in got.collect()} == {i: len(held[k] & set(range(a, b))) for i, k, a, b in asked}


def test_overlaps_do_not_hide_a_hole(spark):
    index = spark.createDataFrame([(1, 0, 0, 60), (1, 0, 20, 60), (1, 0, 100, 200), (1, 0, 100, 200), (2, 0, 0, 100), (2, 1, 0, 50), (2, 1, 50, 100)],
                                  "clip_id bigint, channel int, start_sample bigint, end_sample bigint")
    frames = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 200), (2, 0, 0, 100), (3, 0, 0, 100), (1, 2, 200, 200)],
                                   "clip_id bigint, frame bigint, start_sample bigint, end_sample bigint")
    got = {(r.clip_id, r.frame): (r.tracks, r.covered, r.complete) for r in ix.frame_coverage(frames, index, 1).collect()}
    assert got == {(1, 0): (1, 60, False), (1, 1): (1, 100, True), (2, 0): (2, 200, False), (3, 0): (0, 0, False), (1, 2): (0, 0, False)}
    assert {r.frame: r.complete for r in ix.frame_coverage(frames.where("clip_id = 2"), index, 2).collect()} == {0: True}


def test_coverage_of_random_blocks_equals_counting(spark):
    rng = random.Random(23)
    blocks = [(c, ch, a, a + rng.randrange(0, 30)) for c in range(3) for ch in range(3) for a in (rng.randrange(400) for _ in range(40))]
    frames = [(c, f, f * 17, f * 17 + 17) for c in range(4) for f in range(24)]
    held = {}
    for c, ch, s, e in blocks:
        held.setdefault((c, ch), set()).update(range(s, e))
    want = {}
    for c, f, s, e in frames:
        got = [len(held.get((c, ch), set()) & set(range(s, e))) for ch in range(3)]
        want[c, f] = (sum(g > 0 for g in got), sum(got), all(g == e - s for g in got))
    out = ix.frame_coverage(
        spark.createDataFrame(frames, "clip_id bigint, frame bigint, start_sample bigint, end_sample bigint"),
        spark.createDataFrame(blocks, "clip_id bigint, channel int, start_sample bigint, end_sample bigint"), 3, 50)
    assert {(r.clip_id, r.frame): (r.tracks, r.covered, r.complete) for r in out.collect()} == want
    assert any(v[2] for v in want.values()) and "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)


def test_dyadic_cover_is_exact_and_short(spark):
    rng = random.Random(4)
    ranges = [(a, a + n) for a in (*range(-9, 20), 10**12 + 7) for n in range(-1, 20)] + [(a, a + rng.randrange(1, 10**7)) for a in (rng.randrange(10**9) for _ in range(50))]
    for r in spark.createDataFrame(ranges, "a bigint, b bigint").withColumn("nodes", dyadic_cover(F.col("a"), F.col("b"))).collect():
        parts = sorted((n.block << n.level, (n.block + 1) << n.level) for n in r.nodes)
        if r.a >= r.b:
            assert parts == []
            continue
        assert parts[0][0] == r.a and parts[-1][1] == r.b and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (r.b - r.a).bit_length()


def test_long_requests_cost_a_logarithm(spark):
    index = spark.createDataFrame([(1, k, k * 100, k * 100 + 100) for k in range(3000)], "k bigint, n bigint, ps bigint, pe bigint")
    asked = spark.createDataFrame([(i, 1, i, 290_000 + i) for i in range(5)], "i bigint, k bigint, s bigint, e bigint")
    blocks = asked.select(F.explode(dyadic_cover(F.floor(F.col("s") / 16), F.floor((F.col("e") - 1) / 16) + 1))).count()
    assert blocks <= 5 * 2 * 15  # 18,000 buckets each
    assert interval_join(asked, index, ["k"], ("s", "e"), ("ps", "pe"), 16).count() == sum(
        1 for i in range(5) for k in range(3000) if k * 100 + 100 > i and k * 100 < 290_000 + i)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_with_long_spans_on_either_side(spark, width):
    rng = random.Random(31)
    span = lambda n: (lambda s: (s, s + rng.randrange(-2, n)))(rng.randrange(-50, 500))
    a = spark.createDataFrame([(i, rng.randrange(2), *span(rng.choice([3, 400]))) for i in range(70)], "a bigint, k bigint, s bigint, e bigint")
    b = spark.createDataFrame([(i, rng.randrange(2), *span(rng.choice([5, 600]))) for i in range(80)], "b bigint, k bigint, ps bigint, pe bigint")
    naive = a.join(b, (a.k == b.k) & (b.pe > a.s) & (b.ps < a.e) & (a.s < a.e) & (b.ps < b.pe)).select("a", "b")
    got = interval_join(a, b, ["k"], ("s", "e"), ("ps", "pe"), width).select("a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, naive.collect()))


def rows_scanned(df):
    """Rows that the file scan gave after leaving out row groups and pages by their statistics."""
    df.collect()
    todo, seen = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            seen += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_stored_index_reads_in_proportion_to_the_range(spark):
    rows = spark.range(0, 60_000).select(
        (F.col("id") % 3).alias("clip_id"), (F.floor(F.col("id") / 3) % 2).cast("int").alias("channel"), (F.floor(F.col("id") / 6) * 100).alias("start_sample")
    ).withColumn("end_sample", F.col("start_sample") + 100)
    stored = ix.stored_index(rows.repartition(5), fresh_path(spark, "index"), rows_per_group=500)
    for start, end, want in ((200_000, 210_000, 600), (200_000, 300_000, 6000), (999_900, 999_901, 6)):
        got = ix.extract_range(stored, start, end)
        assert got.count() == want
        assert rows_scanned(got) <= want + 6 * 2 * 500
    assert rows_scanned(stored.where("clip_id = 1 and channel = 0 and end_sample > 5000 and start_sample < 6000")) <= 1500


def test_digest_is_of_values_and_places_in_any_order(spark):
    rng = random.Random(6)
    prime = (1 << 31) - 1
    data = [(t, b, p, rng.randrange(-(1 << 23), 1 << 23)) for t in range(2) for b in range(5) for p in (0, 1, 2, 1000, 70_000 + b)]
    got = {(r.track_id, r.block_no): (r.samples, r.digest) for r in au.digest_from_samples(
        spark.createDataFrame(data, "track_id int, block_no bigint, pos int, s24 int").repartition(7)).collect()}
    for (t, b), (n, digest) in got.items():
        sums = [sum((s + (1 << 23) + 1) * pow(base, p, prime) for tt, bb, p, s in data if (tt, bb) == (t, b)) % prime for base in au.DIGEST_BASES]
        assert (n, digest) == (5, sums[0] * (1 << 31) + sums[1])


def test_only_blocks_that_differ_are_compared_by_sample(spark):
    schema = "track_id int, block_no bigint, pos int, s24 int"
    a = [(1, b, p, b * 7 + p) for b in range(40) for p in range(8)] + [(2, 0, 0, 5)]
    b = [(t, k, p, s + 1 if (k, p) == (3, 2) else s) for t, k, p, s in a if (k, p) != (5, 1) and t == 1] + [(1, 6, 99, 1), (3, 0, 0, 1)]
    got = {r.track_id: tuple(r)[1:] for r in au.path_equivalence(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {1: (321, 318, 1, 1, 1), 2: (1, 0, 0, 1, 0), 3: (1, 0, 0, 0, 1)}
    swapped = [(t, k, {0: 1, 1: 0}.get(p, p), s) if k == 9 else (t, k, p, s) for t, k, p, s in a]
    assert au.path_equivalence(spark.createDataFrame(a, schema), spark.createDataFrame(swapped, schema)).where("track_id = 1").first().different == 2


def test_channels_past_the_limit_are_reported(spark):
    rows = [(1, "pcm.63"), (1, "pcm.64"), (2, "pcm.12345678901"), (3, "pcm.x"), (3, "avc.99"), (4, "pcm.5")]
    packets = spark.createDataFrame([(c, 0, k, 10) for c, k in rows], "clip_id bigint, channel int, essence_key string, payload_len bigint")
    assert sorted((r.clip_id, r.c) for r in packets.select("clip_id", ix.pcm_channel(F.col("essence_key")).alias("c")).where("c is not null").collect()) == [(1, 63), (4, 5)]
    found = ix.limit_audit(packets, {"channel_number": 63}).where("cap = 'channel_number'").collect()
    assert {(r.clip_id, r.value) for r in found} == {(1, 64), (2, 12345678901)}
