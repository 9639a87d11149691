"""Audio against video extent, against the plain definition."""

import random

from cliptide.operators import index as ix
from test_ranges import plan_of


def test_frames_past_the_audio_are_counted_without_opening_frames(spark):
    rng = random.Random(12)
    rates = [(50, 1), (25, 1), (30000, 1001), (60000, 1001), (24000, 1001), (7, 3)]
    clips = [(i, *rng.choice(rates), rng.choice([0, 1, 2, 59, 60, 300, -4, None]), rng.choice([48000, 44100, 8000])) for i in range(300)]
    clips += [(7, 25, 1, 90, 48000), (400, 25, 1, 10**12, 48000)]
    audio = {i: rng.choice([0, 1, 1919, 1920, 1921, 40_000, rng.randrange(600_000)]) for i in range(0, 300, 2)} | {7: 100_000, 400: 48_000}
    index = spark.createDataFrame([(i, ch, n + ch) for i, n in audio.items() for ch in (0, 1)], "clip_id bigint, channel int, end_sample bigint")
    want: dict[int, int] = {}
    for i, num, den, n, rate in clips:
        if i in audio and i != 400:
            want[i] = want.get(i, 0) + sum((f + 1) * rate * den // num > audio[i] for f in range(0, n or 0, 2))
    want[400] = len(range(26, 10**12, 2))
    frame = spark.createDataFrame(clips, "clip_id bigint, rate_num int, rate_den int, duration_frames bigint, sample_rate int")
    out = ix.av_extent(frame, index)
    assert "Generate" not in plan_of(out)
    rows = out.collect()
    assert len(rows) == sum(c[0] in audio for c in clips) and {r.clip_id: r.outside_frames for r in rows} == want
    assert [r.delta_seconds for r in rows if r.clip_id == 400] == [1 - 10**12 / 25]
