"""Frames of clips without audio are told without a shuffle of frames; clips that come twice count as in SQL."""

from pyspark.sql import functions as F

from cliptide.functions import timing as t
from cliptide.operators import index as ix
from test_ranges import plan_of


def test_frames_of_clips_are_opened_after_the_clips_meet_their_channels(spark):
    clips = spark.createDataFrame([(i, 4, 100, 25, 1) for i in range(6)] + [(1, 2, 100, 25, 1), (None, 1, 100, 25, 1), (9, 0, 100, 25, 1)],
                                  "clip_id bigint, duration_frames bigint, sample_rate int, rate_num int, rate_den int")
    index = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 0, 6), (2, 0, 4, 16), (2, 1, 0, 16), (7, 0, 0, 50)],
                                  "clip_id bigint, channel int, start_sample bigint, end_sample bigint")
    out = ix.clip_frame_coverage(clips, index, 2)
    got = sorted(((r.clip_id, r.frame, r.tracks, r.covered, r.complete) for r in out.collect()), key=str)
    one = [(1, 0, 2, 16, False), (1, 1, 2, 12, False)]  # frames 0 and 1 of clip 1 come twice
    want = one * 2 + [(1, 2, 0, 0, False), (1, 3, 0, 0, False), (2, 0, 1, 4, False), *[(2, f, 2, 8, True) for f in (1, 2, 3)]]
    want += [(i, f, 0, 0, False) for i in (0, 3, 4, 5) for f in range(4)] + [(None, 0, 0, 0, False)]
    assert [r for r in got if r[0] != 1] == sorted((w for w in want if w[0] != 1), key=str)
    assert sorted((r[:4] for r in got if r[0] == 1)) == sorted(w[:4] for w in want if w[0] == 1)
    # The branch of clips without audio opens frames last: no exchange lies above its Generate.
    branch = plan_of(out.where(F.col("clip_id") == 4)).split("Union", 1)[1]
    assert branch.index("Generate") < (branch.index("Exchange") if "Exchange" in branch else len(branch))
    plain = ix.frame_coverage(t.frame_samples(clips), index, 2)
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.collect()))
