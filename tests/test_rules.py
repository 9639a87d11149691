"""Rules on rows: validation labels in their order, limits, choices and sinks."""

import pytest
from pyspark.sql import functions as F

from cliptide.functions import rules as r
from cliptide.operators import audio as au
from cliptide.operators import capability as cap
from cliptide.operators import index as ix
from cliptide.operators import metadata as md
from cliptide.sources import sinks
from cliptide.sources.tables import fresh_path, shared_dir

c = F.col
GOOD = dict(
    public_uri="media://local/source/1", binding_ref="opaque-1", proxy_binding_ref="opaque-p", audio_authority="Original",
    proxy_aac_authoritative=False, playback_input="ProxyIfAvailable", proxy_available=True, picture="Proxy", mode="ProxyPreview",
    lanes=[(i, i, "Mono", True) for i in range(4)], sample_rate=48000, bit_depth=24, project_channels=4, project_rate=48000, rate_den=1,
    duration_frames=100, range_start=0, range_end=100, timing_compatible=True, contract_version="1", source_id="s-1",
    workspace_uri="media://ws", original_media_id=None, proxy_media_id="media://p/1", private_path_exposed=False, proxy_bound=True,
    proxy_video=True)
SCHEMA = (
    "public_uri string, binding_ref string, proxy_binding_ref string, audio_authority string, proxy_aac_authoritative boolean, "
    "playback_input string, proxy_available boolean, picture string, mode string, "
    "lanes array<struct<lane_index:int,source_channel:int,kind:string,authoritative:boolean>>, sample_rate int, bit_depth int, "
    "project_channels int, project_rate int, rate_den int, duration_frames bigint, range_start bigint, range_end bigint, timing_compatible boolean, "
    "contract_version string, source_id string, workspace_uri string, original_media_id string, proxy_media_id string, "
    "private_path_exposed boolean, proxy_bound boolean, proxy_video boolean")
CASES = [
    ({}, "ok"),
    (dict(playback_input="Original", picture="Original", mode="OriginalMedia", range_start=10, range_end=90, proxy_binding_ref=None), "ok"),
    (dict(public_uri="http://x/1"), r.URI_MISSING),
    (dict(public_uri="media://x\\y"), r.URI_MISSING),
    (dict(binding_ref="/srv/a.mxf"), r.PATH_EXPOSED),
    (dict(proxy_binding_ref="file:a"), r.PATH_EXPOSED),
    (dict(proxy_aac_authoritative=True, audio_authority="ProxyAac"), r.PROXY_AUDIO),
    (dict(audio_authority="ProxyAac"), r.AUDIO_MISSING),
    (dict(picture="Original"), r.PICTURE_MISMATCH),
    (dict(playback_input="Original"), r.INPUT_MISMATCH),
    (dict(lanes=[]), r.NO_LANES),
    (dict(lanes=[(0, 0, "Mono", True), (0, 1, "Mono", True)]), r.STEREO),
    (dict(lanes=[(0, 0, "Stereo", True)] * 4), r.STEREO),
    (dict(project_channels=5), r.PROJECT_AUDIO),
    (dict(duration_frames=0), r.PROJECT_AUDIO),
    (dict(project_rate=44100), r.PROJECT_AUDIO),
    (dict(range_start=50, range_end=50), r.RANGE),
    (dict(timing_compatible=None), r.TIMING_UNKNOWN),
    (dict(proxy_binding_ref=None), r.MODE),
    (dict(public_uri="x", binding_ref="/a", lanes=[]), r.URI_MISSING),
    (dict(contract_version="  "), r.URI_MISSING),
    (dict(contract_version=None), r.URI_MISSING),
    (dict(workspace_uri="http://ws"), r.URI_MISSING),
    (dict(workspace_uri=None), r.URI_MISSING),
    (dict(original_media_id="x\\y"), r.URI_MISSING),
    (dict(proxy_media_id="media://file:p"), r.URI_MISSING),
    (dict(proxy_media_id=None), "ok"),
    (dict(source_id="/srv/s"), r.PATH_EXPOSED),
    (dict(private_path_exposed=True), r.PATH_EXPOSED),
    (dict(private_path_exposed=True, lanes=[]), r.PATH_EXPOSED),
    (dict(proxy_bound=False), r.MODE),
    (dict(proxy_video=None), r.MODE),
    (dict(proxy_bound=False, timing_compatible=False), r.TIMING_UNKNOWN),
]


def test_prepared_input_rules_in_order(spark):
    rows = [tuple({**GOOD, **change}.values()) for change, _ in CASES]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.monotonically_increasing_id())
    got = [x.outcome for x in df.select("n", r.validate_prepared().alias("outcome")).orderBy("n").collect()]
    assert got == [want for _, want in CASES]


def test_sample_counts(spark):
    df = spark.createDataFrame([(2880, 24, 1), (2881, 24, 1), (96, 16, 2), (96, 0, 1), (96, 12, 1), (96, 24, 0)], "n bigint, d int, ch int")
    assert [x.v for x in df.select(ix.sample_count(c("n"), c("d"), c("ch")).alias("v")).collect()] == [960, None, 24, None, None, None]


def test_step_stays_in_range(spark):
    df = spark.createDataFrame([(10, 1000, 10, 90), (10, -1000, 10, 90), (10, 5, 10, 90), (3, 1, 7, 7)], "f bigint, d bigint, s bigint, e bigint")
    assert [x.v for x in df.select(r.step_frame(*[c(n) for n in "fdse"]).alias("v")).collect()] == [89, 10, 15, 7]


def test_cut_of_the_news_demo(spark):
    cut = spark.createDataFrame([(1, 50, 1, 20, 80), (2, 50, 1, 21, 80), (3, 50, 1, 9, 9)], "clip_id bigint, rate_num int, rate_den int, cut_in bigint, cut_out bigint")
    got = {x.clip_id: (x.preview_frames, x.skipped, x.seconds) for x in ix.cut_summary(cut, 2).collect()}
    assert got == {1: (30, 30, 1.2), 2: (29, 30, 1.18), 3: (0, 0, 0.0)}


def test_track_kinds_and_channels(spark):
    df = spark.createDataFrame([("vide",), ("soun",), ("mdta",), ("hint",)], "h string")
    assert [x.k for x in df.select(ix.track_kind(c("h")).alias("k")).collect()] == ["video", "audio", "data", "other"]
    keys = spark.createDataFrame([("pcm.3",), ("pcm.64",), ("avc.1",), ("pcm.x",)], "k string")
    assert [x.n for x in keys.select(ix.pcm_channel(c("k")).alias("n")).collect()] == [3, None, None, None]


def test_first_tag_wins(spark):
    uses = spark.createDataFrame([("a",), ("b",), ("c",)], "local_tag string")
    dim = spark.createDataFrame([("a", "late", 5), ("a", "first", 1), ("b", "only", 3)], "local_tag string, property string, position int")
    assert {x.local_tag: x.property for x in md.resolve_tags(uses, dim).collect()} == {"a": "first", "b": "only", "c": None}


def test_device_preference(spark):
    rows = [("h1", 1, "discrete", True), ("h1", 2, "integrated", False), ("h1", 3, "integrated", True), ("h2", 4, "discrete", False), ("h3", 5, "other", True)]
    df = spark.createDataFrame(rows, "host string, capability_id bigint, device_class string, preferred_vendor boolean")
    assert {x.host: x.capability_id for x in cap.preferred_device(df, "host").collect()} == {"h1": 3, "h2": 4, "h3": None}
    assert {x.host: x.status for x in cap.preferred_device(df, "host", False).collect()}["h2"] == "no device advertised"


def test_ownership(spark):
    log = [(1, 7, "destroy", 0), (1, 7, "create", 1), (2, 7, "use", 2), (1, 7, "use", 3), (2, 7, "destroy", 4), (1, 7, "destroy", 5),
           (1, 7, "destroy", 6), (3, 7, "create", 7), (3, 7, "destroy", 8), (3, 7, "use", 9), (1, 7, "use", 10)]
    df = spark.createDataFrame(log, "session_id bigint, resource_id bigint, op string, seq bigint")
    for width in (2, 100):
        got = sorted(cap.ownership_audit(df, width).collect(), key=lambda x: x.seq)
        assert [x.outcome for x in got] == ["unknown-resource", "ok", "not-owner", "ok", "not-owner", "ok", "already-destroyed", "ok", "ok",
                                             "already-destroyed", "not-owner"]


def test_manifest_keeps_private_rows_out(spark):
    names = ["public_uri", "binding_ref", "proxy_binding_ref", "source_id", "workspace_uri", "original_media_id", "proxy_media_id"]
    safe = dict(zip(names, ["media://a", "opaque", None, "s", "media://w", None, "media://p"]))
    cases = [safe, *[{**safe, n: "x file:y"} for n in names], {**safe, "binding_ref": "/srv/x"}]
    rows = [(i, *case.values(), False, 2, 2, 10, 25, 1) for i, case in enumerate(cases)] + [(99, *safe.values(), True, 2, 2, 10, 25, 1)]
    df = spark.createDataFrame(rows, "clip_id bigint, " + ", ".join(f"{n} string" for n in names) + (
        ", private_path_exposed boolean, width int, height int, duration_frames bigint, rate_num int, rate_den int"))
    path = fresh_path(spark, "manifest")
    sinks.write_manifest(df, path)
    assert [x.clip_id for x in sinks.read_manifest(spark, path).collect()] == [0]
    assert sorted(x.clip_id for x in r.path_audit(df, "clip_id").collect()) == [*range(1, 9), 99]


def test_interleave_with_unequal_block_cuts(spark):
    blocks = [(0, 0, 0, [1, 2, 3, 4, 5]), (0, 1, 0, [10, 20]), (0, 1, 2, [30, 40]), (1, 0, 0, [7]), (1, 2, 0, [9]),
              (2, 0, 0, [1, 2]), (2, 1, 0, [5]), (2, 1, 3, [6]), (3, 0, 1, [4, 4]), (3, 1, 1, [5, 5])]
    df = spark.createDataFrame([(a, b, s, len(v), v) for a, b, s, v in blocks],
                               "clip_id bigint, channel int, start_sample bigint, length bigint, samples array<int>")
    for grid in (3, 4096):
        got = {(x.clip_id, x.sample): (x.short, x["values"]) for x in au.interleave(df, 2, grid).collect()}
        for sample, values in enumerate([[1, 10], [2, 20], [3, 30], [4, 40], [5, None]]):
            assert got.pop((0, sample)) == (values[1] is None, values)
        assert got.pop((1, 0)) == (True, [7, None]) and got.pop((3, 1)) == (False, [4, 5]) and got.pop((3, 2)) == (False, [4, 5])
        # A gap inside a cell makes the channel unusable there; beyond it the channel counts again.
        assert got[2, 0][0] == (grid == 4096) and all(k[0] == 2 for k in got)


def test_snapshot_table_survives_a_repeated_batch(spark):
    table = sinks.SnapshotTable(fresh_path(spark, "snap"), "k", "seq", "k bigint, seq bigint, v string")
    batch = lambda *rows: spark.createDataFrame(rows, "k bigint, seq bigint, v string")
    table.upsert(batch((1, 1, "a"), (2, 1, "b")), 0)
    table.upsert(batch((1, 2, "c")), 1)
    table.upsert(batch((1, 2, "c")), 1)
    assert sorted(map(tuple, table.read(spark, 1).collect())) == [(1, 2, "c"), (2, 1, "b")]


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
