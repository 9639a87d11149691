"""The content digest of blocks is the MD5 of all their samples in order, from whole blocks and from single samples."""

import hashlib
import random

from pyspark.sql import functions as F

from cliptide.operators import audio as au


def test_content_digest_is_the_md5_of_whole_blocks_in_any_arrival_order(spark):
    rng = random.Random(9)
    blocks = {(t, b): [rng.randrange(-(1 << 23), 1 << 23) for _ in range(rng.choice([1, 2, 64, 700]))] for t in range(3) for b in range(20)}
    want = {k: hashlib.md5(",".join(map(str, v)).encode()).hexdigest() for k, v in blocks.items()}
    whole = spark.createDataFrame([(t, b, [x / au.FULL_SCALE for x in v]) for (t, b), v in blocks.items()], "track_id int, block_no bigint, samples array<float>")
    samples = [(t, b, p, x) for (t, b), v in blocks.items() for p, x in enumerate(v)]
    rng.shuffle(samples)
    single = spark.createDataFrame(samples, "track_id int, block_no bigint, pos int, s24 int").repartition(7)
    for got in (au.block_digest(whole), au.content_from_samples(single)):
        assert {(r.track_id, r.block_no): r.digest for r in got.collect()} == want
    swapped = single.withColumn("pos", F.when(F.col("pos") < 2, 1 - F.col("pos")).otherwise(F.col("pos")))
    got = {(r.track_id, r.block_no): r.digest for r in au.content_from_samples(swapped).collect()}
    assert all((got[k] == want[k]) == (len(v) < 2) for k, v in blocks.items())
