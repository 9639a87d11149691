"""Replays: published transcripts, and block-parallel folds against one sequential fold."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cliptide.operators import fold, machines, player as pl
from cliptide.operators import pictures as pic
from cliptide.operators.fold import ordered_fold
from cliptide.operators.probes import NoProbe
from cliptide.operators.scan import div

LOG = "session_id bigint, seq bigint, command string, frame bigint, frame_count bigint, expected_generation bigint, range_start bigint, range_end bigint"


TICKS = "session_id bigint, seq bigint, op string, frame bigint"
SOURCE = "session_id bigint, seq bigint, sub int, op string, target bigint, stale boolean, range_start bigint, range_end bigint"


def random_source(rng, sessions, length):
    ops = ["load_source", "preload_source", "set_active_source", "set_active_range", "cue_frame", "prepare_anchor", "play", "pause", "stop",
           "close_active_source", "unload_source"]
    weights = [3, 4, 4, 5, 6, 6, 6, 2, 1, 1, 1]
    return [(s, i, 0, rng.choices(ops, weights)[0], rng.randrange(0, 100), rng.random() < 0.05, s * 9, 80 + s) for s in range(sessions) for i in range(length)]


def outcome(spark, script, start=10, end=90, **kw):
    rows = [(1, i + 1, *step, *([None] * (4 - len(step))), start, end) for i, step in enumerate(script)]
    return sorted(pl.replay(spark.createDataFrame(rows, LOG), **kw).collect(), key=lambda r: r.seq)


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_command_script(spark, block_rows):
    script = [("LoadPreparedInput",), ("Play",), ("Prepare",), ("Cue", 90), ("Cue", 10), ("Preroll",), ("Snapshot",), ("Play",),
              ("Play", None, 2), ("Pause",), ("Seek", 90), ("Seek", 20), ("Play",), ("Preroll",), ("Play",), ("Stop",), ("Unload",)]
    got = outcome(spark, script, block_rows=block_rows)
    assert [r.accepted for r in got] == [True, False, True, False, True, True, True, True, True, True, False, True, False, True, True, True, True]
    assert [r.status for r in got] == [
        "Loaded", "Loaded", "Loaded", "Loaded", "Ready", "Ready", "Ready", "Playing", "Playing", "Paused", "Paused", "Paused", "Paused",
        "Paused", "Playing", "Stopped", "Empty"]
    assert [r.frame for r in got][3:13] == [None, 10, 10, 10, 10, 12, 12, 12, 20, 20]
    assert [r.generation for r in got] == [1, 1, 2, 2, 3, 4, 4, 5, 6, 7, 7, 8, 8, 9, 10, 11, 12]


def test_fault_scenario(spark):
    script = [("Play",), ("Seek", 0), ("LoadPreparedInput",), ("Cue", 60), ("Prepare",), ("Play",), ("Cue", 0), ("Snapshot",), ("Play",),
              ("Seek", 60), ("Play", None, 1), ("Play", None, 1), ("Stop",), ("Unload",), ("Seek", 0)]
    got = outcome(spark, script, start=0, end=50)
    assert sum(r.accepted for r in got) == 9 and sum(not r.accepted for r in got) == 6
    assert [r.status for r in got] == ["Empty", "Empty", "Loaded", "Loaded", "Loaded", "Loaded", "Ready", "Ready", "Playing", "Playing",
                                       "Playing", "Playing", "Stopped", "Empty", "Empty"]
    assert [r.loaded for r in got if not r.accepted] == [False, False, True, True, True, False]
    counters = pl.command_counters(spark.createDataFrame(got)).first()
    assert counters.mutated_by_rejection == 0


def test_completion_at_the_end_of_the_range(spark):
    got = outcome(spark, [("LoadPreparedInput",), ("Prepare",), ("Cue", 88), ("Play",), ("Play", None, 5), ("Play",), ("Cue", 10)])
    assert (got[4].status, got[4].frame) == ("Completed", 89)
    assert got[5].reason == "IllegalCommandForState" and got[6].status == "Ready"


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_preroll_with_a_target(spark, block_rows):
    """A target moves the frame and arms at once; outside the range or without one it is refused and changes nothing."""
    script = [("LoadPreparedInput",), ("Preroll", 20), ("Prepare",), ("Preroll",), ("Preroll", 90), ("Cue", 10), ("Preroll", 12), ("Play",), ("Pause",),
              ("Seek", 30), ("Play",), ("Preroll", 9), ("Preroll", 30), ("Play", None, 2)]
    got = outcome(spark, script, block_rows=block_rows)
    assert [r.reason for r in got] == [
        None, "PrepareRequired", None, "PrepareRequired", "CueOutsideActiveRange", None, None, None, None, None, "PrepareRequired",
        "CueOutsideActiveRange", None, None]
    assert [r.frame for r in got] == [None] * 5 + [10, 12, 12, 12, 30, 30, 30, 30, 32]
    assert [r.armed for r in got] == [False] * 5 + [True] * 4 + [False] * 3 + [True] * 2


SNAPSHOT = """session_id bigint, seq bigint, reason string, status string, loaded boolean, has_range boolean, frame bigint, range_start bigint,
    range_end bigint, rate_num int, rate_den int, public_uri string, source_mode string, audio_authority string, lane_count int, sample_start bigint,
    sample_end bigint, prepared_frames bigint, video_payload_ready boolean, audio_payload_ready boolean, transport_ready boolean,
    private_path_exposed boolean, proxy_aac_authoritative boolean, realtime_verified boolean, visual_verified boolean,
    audio_device_verified boolean, av_sync_verified boolean"""


def seen_by_observers(spark, **change):
    row = {"session_id": 1, "seq": 1, "reason": None, "status": "Ready", "loaded": True, "has_range": True, "frame": 12, "range_start": 10,
           "range_end": 90, "rate_num": 25, "rate_den": 1, "public_uri": "media://a", "source_mode": "OriginalMedia", "audio_authority": "Original",
           "lane_count": 3, "sample_start": 23040, "sample_end": 24960, "prepared_frames": 6, "video_payload_ready": True, "audio_payload_ready": True,
           "transport_ready": True, "private_path_exposed": False, "proxy_aac_authoritative": False, "realtime_verified": False,
           "visual_verified": False, "audio_device_verified": True, "av_sync_verified": False, **change}
    df = spark.createDataFrame([row], SNAPSHOT).withColumn("lanes", pl.source_lanes(F.col("lane_count")))
    return pl.passive_view(df).first(), pl.client_predicates(df).first()


def test_passive_view(spark):
    v, p = seen_by_observers(spark)
    assert [tuple(x) for x in v.lanes] == [(0, "A1", 0, 0), (1, "A2", 0, 1), (2, "A3", 1, 0)]
    assert (v.sample_start, v.sample_end, v.transport, v.public_uri, v.audio, v.prepared_frames) == (23040, 24960, "Ready", "media://a", "Original", 6)
    assert (v.monitor, v.monitor_frame, v.presented, v.audio_device_verified, v.last_rejection, p.error) == ("status:Ready", None, False, True, None, None)
    v, p = seen_by_observers(spark, visual_verified=True, reason="PrepareRequired")
    assert (v.monitor, v.monitor_frame, v.presented, v.last_rejection, p.error) == ("picture", 12, True, "PrepareRequired", "PrepareRequired")
    # Other audio than the original shows neither lanes nor a cursor.
    v, _ = seen_by_observers(spark, audio_authority="ProxyAac")
    assert (v.wave, v.lanes, v.sample_start, v.audio) == ("none", [], None, "ProxyAac")
    v, _ = seen_by_observers(spark, loaded=False, frame=None, status="Empty", lane_count=None)
    assert (v.public_uri, v.audio, v.picture, v.lanes, v.source_loaded) == (None, "none", "none", [], False)


@pytest.mark.parametrize("flag", ["private_path_exposed", "proxy_aac_authoritative"])
def test_hidden_rows_are_blank(spark, flag):
    v, p = seen_by_observers(spark, visual_verified=True, reason="SourceNotLoaded", **{flag: True})
    assert [x for x in v[2:] if x not in ("empty", "none", "Empty", None, False, 0, [])] == []
    assert p.error == "SourceNotLoaded" and not p.confirmed_position


def random_log(rng, sessions, length, careful):
    """Commands of which a share carries an expected generation, right for a careful client."""
    names = ["LoadPreparedInput", "Prepare", "Cue", "Preroll", "Play", "Play", "Pause", "Seek", "Stop", "Unload", "Snapshot"]
    weights = [2, 4, 5, 5, 8, 4, 4, 4, 1, 1, 2]
    machine, rows = machines.player(), []
    for s in range(sessions):
        state = machine.initial
        for seq in range(1, (length if s == 0 else length // 8) + 1):
            command = rng.choices(names, weights)[0]
            expected = None
            if rng.random() < 0.6:
                expected = state[5] if rng.random() < careful else rng.randrange(0, 40)
            row = (seq, command, rng.randrange(0, 100), rng.choice([None, 0, 1, 7]), expected, s * 3, 60 + s * 9)
            state, _ = machine.step(state, row)
            rows.append((s, *row))
    return rows


def sequential(machine, rows, width):
    out, key, state = [], None, None
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        if r[0] != key:
            key, state = r[0], machine.thaw(machine.initial)
        state, produced = machine.step(state, r[1:])
        out.extend((key, *p) for p in produced)
    return out


@pytest.mark.parametrize("careful,block_rows", [(1.0, 9), (0.5, 16), (0.0, 5)])
def test_blocks_give_the_sequential_result(spark, careful, block_rows):
    rows = random_log(random.Random(int(careful * 10) + block_rows), 4, 120, careful)
    got = sorted(tuple(r) for r in pl.replay(spark.createDataFrame(rows, LOG), block_rows=block_rows).collect())
    assert got == sequential(machines.player(), rows, 0)


def test_lifecycle(spark):
    ops = ["Play", "Pause", "Prepare", "Prepare", "Play", "Pause", "Seek", "Play", "Drain", "Drained", "Seek", "NewSession", "Prepare", "Prepare"]
    ready = [True, True, False, True] + [True] * 10
    facts = [True] * 12 + [False, True]
    rows = [(1, i, o, facts[i], ready[i]) for i, o in enumerate(ops)]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, op string, facts_ok boolean, preroll_ready boolean")
    for block_rows in (4, 100):
        got = sorted(pl.lifecycle_replay(df, block_rows).collect(), key=lambda r: r.seq)
        assert [r.status for r in got] == ["Idle", "Idle", "Preparing", "Ready", "Playing", "Paused", "Paused", "Playing", "Draining",
                                           "Completed", "Completed", "Idle", "Failed", "Failed"]
        assert [r.accepted for r in got] == [False, False, True, True, True, True, True, True, True, True, False, True, True, False]


def test_source_lifecycle_blocks(spark):
    rows = random_source(random.Random(4), 3, 150)
    df = spark.createDataFrame(rows, SOURCE)
    got = sorted(pl.source_replay(df, block_rows=11).collect(), key=lambda r: (r.session_id, r.seq))
    want = sequential(machines.source_lifecycle(), rows, 0)
    assert [tuple(r) for r in got] == want and any(r.play_ready for r in got)


def test_coverage_resets(spark):
    ticks = [(1, i, *x) for i, x in enumerate([("tick", 0), ("tick", 10), ("tick", 25), ("tick", 3), ("reset", 0), ("tick", 3), ("tick", 27), ("tick", 28)])]
    df = spark.createDataFrame(ticks, "session_id bigint, seq bigint, op string, frame bigint")
    for block_rows in (2, 100):
        got = sorted(pl.coverage_replay(df, block_rows).collect(), key=lambda r: r.seq)
        assert [r.label for r in got] == ["submitted", "covered", "submitted", "covered", "reset", "submitted", "covered", "submitted"]
        assert got[-1].submissions == 4


def picture_rows(rng, clips, n, wrap):
    """Decode order with references ahead of the pictures between them, refreshed now and then."""
    rows = []
    for clip in range(clips):
        poc, i = 0, 0
        while i < n:
            if i == 0 or rng.random() < 0.02:
                rows.append((clip, i, True, True, 0, 0)); poc = 0; i += 1
                continue
            ahead = rng.choice([2, 4, 6])
            group = [(poc + ahead, True)] + [(poc + k, False) for k in range(2, ahead, 2)]
            for p, ref in group:
                rows.append((clip, i, False, ref, p % wrap, p)); i += 1
            poc += ahead
    return rows


PICTURE = "clip_id bigint, decode_no bigint, idr boolean, reference boolean, poc_lsb bigint, poc bigint"


@pytest.mark.parametrize("chunk", [5, 1000])
def test_counter_unroll_recovers_the_order(spark, chunk):
    rows = picture_rows(random.Random(1), 3, 300, 64)
    got = {(r.clip_id, r.decode_no): r.poc for r in pic.unroll_order(spark.createDataFrame(rows, PICTURE).drop("poc"), 64, chunk).collect()}
    assert got == {(r[0], r[1]): r[5] for r in rows}


def test_release_order_equals_presentation_order(spark):
    rows = picture_rows(random.Random(8), 3, 200, 1 << 20)
    known, order = [], {}
    for clip in range(3):
        seg, keyed = 0, []
        for r in [r for r in rows if r[0] == clip]:
            seg += r[2]
            keyed.append((seg, r[5], r[1]))
            known.append((clip, seg, r[1], r[5]))
        order[clip] = [d for _, _, d in sorted(keyed)]
    df = spark.createDataFrame(known, "clip_id bigint, segment bigint, decode_no bigint, poc bigint")
    seen = sorted(pic.release_order(pic.presentation_order(df), 2).collect(), key=lambda r: (r.clip_id, r.release_no))
    for clip in range(3):
        assert [r.decode_no for r in seen if r.clip_id == clip] == order[clip]
        assert [r.release_no for r in seen if r.clip_id == clip] == list(range(1, len(order[clip]) + 1))


def test_prepared_windows(spark):
    ticks = spark.createDataFrame([(1, 1, 0, 0, 50), (1, 2, 3, 0, 50), (1, 3, 6, 0, 50)], "session_id bigint, seq bigint, frame bigint, range_start bigint, range_end bigint")
    got = sorted(pl.prepared_window(ticks).collect(), key=lambda r: r.seq)
    assert [r.window for r in got] == [list(range(0, 6)), list(range(1, 9)), list(range(4, 12))]
    assert [r.discarded for r in got] == [[], [0], [1, 2, 3]] and got[1].added == [6, 7, 8]


def test_each_session_has_its_own_range(spark):
    script = [("LoadPreparedInput",), ("Prepare",), ("Cue", 30), ("Play",), ("Play", None, 15)]
    rows = [(s, i + 1, *step, *([None] * (4 - len(step))), a, b) for s, (a, b) in {1: (0, 20), 2: (25, 40), 3: (0, 100)}.items()
            for i, step in enumerate(script)]
    got = {(r.session_id, r.seq): r for r in pl.replay(spark.createDataFrame(rows, LOG)).collect()}
    assert got[1, 3].reason == "CueOutsideActiveRange" and got[2, 3].accepted and got[3, 3].accepted
    assert [(got[s, 5].status, got[s, 5].frame) for s in (2, 3)] == [("Completed", 39), ("Playing", 45)]
    assert (got[2, 1].range_start, got[2, 2].range_start, got[2, 2].range_end) == (None, 25, 40)


def told_starts(machine, rows, size):
    """Blocks whose end the composed summaries get wrong or are not sure of, and calls of the rules a row."""
    state, told, missed, calls = machine.initial, machine.initial, 0, 0
    for at in range(0, len(rows), size):
        assert state == told
        summary = machine.probe()
        for r in rows[at : at + size]:
            state, _ = machine.step(state, r[1:])
            summary.step(r[1:])
        calls += summary.calls
        told, sure = summary.follow(json.loads(json.dumps(summary.result())), told)
        assert not sure or tuple(told) == state
        missed += not sure
        told = state
    return missed, calls / len(rows)


def long_logs():
    guarded, player = [], machines.player()
    state = player.initial
    for r in random_log(random.Random(21), 1, 2000, 1.0):
        row = (*r[1:5], state[5], *r[6:])
        state, _ = player.step(state, row)
        guarded.append((r[0], *row))
    script = [("LoadPreparedInput", None, None), ("Prepare", None, None), ("Cue", 5, None), *[("Play", None, 1)] * 1700]
    play = [(1, i + 1, *step, None, 0, 10**6) for i, step in enumerate(script)]
    ended = [(*r[:-1], 700) for r in play]
    ticks = [(1, i + 1, "tick", i) for i in range(1700)]
    resets = [(1, i + 1, "reset" if i % 97 == 96 else "tick", i * 3 % 500) for i in range(1700)]
    rng = random.Random(3)
    life = [(1, i + 1, rng.choice(["Play", "Pause", "Seek"] * 30 + ["Prepare", "NewSession", "Drain", "Drained"]), True, True) for i in range(1700)]
    jumps = [(1, i + 1, "tick", 4000 if i == 5 else i * 7 % 900) for i in range(1700)]
    source = random_source(random.Random(9), 1, 1700)
    return [
        (player, random_log(random.Random(5), 1, 2000, 1.0)), (player, guarded), (player, play), (player, ended),
        (player, [(*r[:5], 999 if i % 29 == 0 else None, *r[6:]) for i, r in enumerate(random_log(random.Random(2), 1, 2000, 0.0))]),
        (machines.coverage(), ticks), (machines.coverage(), resets), (machines.coverage(), jumps), (machines.lifecycle(), life),
        (machines.source_lifecycle(), source),
    ]


@pytest.mark.parametrize("log", range(10))
@pytest.mark.parametrize("size", [16, 400])
def test_summaries_tell_every_start_of_a_long_log(log, size):
    """With every start told, blocks are folded once: more than a hundred blocks settle in one round."""
    machine, rows = long_logs()[log]
    rows = [r for r in rows if r[0] == rows[0][0]]
    assert len(rows) > 1600
    missed, calls = told_starts(machine, rows, size)
    assert missed == 0 and calls < 20


@pytest.mark.parametrize("careful", [0.0, 0.5, 0.9])
def test_summaries_are_right_wherever_they_are_sure(careful):
    """Commands that name wrong generations: a summary may not be sure, but then says so."""
    for seed in range(4):
        rows = [r for r in random_log(random.Random(seed), 1, 1500, careful)]
        missed, calls = told_starts(machines.player(), rows, 25)
        assert missed < 30 and calls < 30


def test_summaries_from_every_reachable_start():
    """Any state that some log reaches, as the start of any block of another."""
    for machine, rows in long_logs():
        state, reached = machine.initial, []
        for r in rows[:900]:
            state, _ = machine.step(state, r[1:])
            reached.append(state)
        for at in range(900, 1500, 60):
            block = rows[at : at + 60]
            summary = machine.probe()
            for r in block:
                summary.step(r[1:])
            result = json.loads(json.dumps(summary.result()))
            for start in reached[::17]:
                end = start
                for r in block:
                    end, _ = machine.step(end, r[1:])
                told, sure = summary.follow(result, start)
                assert not sure or tuple(told) == end


@pytest.mark.parametrize("log", [1, 3, 7, 9])
def test_rounds_of_a_long_log(spark, log):
    machine, rows = long_logs()[log]
    ddl = {"player": LOG, "coverage": TICKS, "source": SOURCE}["player" if log < 5 else "coverage" if log < 8 else "source"]
    df = spark.createDataFrame(rows, ddl)
    order = ["seq", "sub"] if "sub" in df.columns else ["seq"]
    got = sorted(tuple(r) for r in ordered_fold(df, ["session_id"], order, machine, div("seq", 16)).collect())
    assert got == sequential(machine, rows, 0)
    _, rounds = fold.block_starts(df.withColumn("_block", div("seq", 16)), ["session_id"], order, machine, 4)
    assert rounds == 1


def test_a_wrong_range_is_repaired_in_a_few_rounds(spark):
    """Ranges that change within a session are not foreseen; the rest of the log follows from one block that is run."""
    rows = [(r[0], *r[1:6], *((0, 90) if i < 700 else (5, 60))) for i, r in enumerate(random_log(random.Random(3), 1, 1400, 1.0))]
    want, state, machine = [], machines.player().initial, machines.player()
    df = spark.createDataFrame(rows, LOG)
    got = sorted(tuple(r) for r in pl.replay(df, block_rows=20).collect())
    assert got == sequential(machine, rows, 0)
    _, rounds = fold.block_starts(df.withColumn("_block", div("seq", 20)), ["session_id"], ["seq"], machine, 4)
    assert rounds <= 6


def test_a_machine_without_summaries(spark):
    machine = replace(machines.lifecycle(), probe=NoProbe)
    rows = [(1, i, o, True, True) for i, o in enumerate(["Prepare", "Play", "Pause", "Play", "Drain", "Drained", "NewSession", "Prepare", "Play"])]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, op string, facts_ok boolean, preroll_ready boolean")
    got = sorted(tuple(r) for r in ordered_fold(df, ["session_id"], ["seq"], machine, div("seq", 2)).collect())
    assert got == sequential(machine, rows, 0)
