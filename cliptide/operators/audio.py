"""PCM statistics, loudness and channel layout.

Samples are signed 24-bit integers, so sums and sums of squares are exact and do not depend on the
order Spark adds them in; floating point appears in the last division only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage
from .scan import ROWS_PER_CHUNK, div, ordered_scan

FULL_SCALE = 8388608
SILENCE_RMS = 1e-4  # -80 dBFS

# Output mode -> channels in output order.
# Samples of a grid cell in which the channels of a clip meet.
SAMPLES_PER_CELL = 4096

ROUTES = {"none": [], "monitor": [3, 0], "four-mono": [0, 1, 2, 3]}


def to_s24(samples: Column) -> Column:
    """Scaled floats back to 24-bit integers."""
    return F.transform(samples, lambda x: F.floor(x.cast("double") * FULL_SCALE).cast("int"))


def scaled(sample: Column) -> Column:
    """24-bit integer to a float clamped to [-1, 1]."""
    return F.greatest(F.least(sample / F.lit(float(FULL_SCALE)), F.lit(1.0)), F.lit(-1.0))


def _energy(square: Column) -> list[Column]:
    """Sum of squares as three 16-bit limbs: BIGINT buffers stay exact for 10^14 samples."""
    return [
        F.sum(F.shiftright(square, 32)).alias("_e2"),
        F.sum(F.shiftright(square, 16).bitwiseAND(F.lit(0xFFFF))).alias("_e1"),
        F.sum(square.bitwiseAND(F.lit(0xFFFF))).alias("_e0"),
    ]


def _energy_total() -> Column:
    wide = lambda n, w: F.col(n).cast("decimal(38,0)") * w
    return (wide("_e2", 1 << 32) + wide("_e1", 1 << 16) + wide("_e0", 1)).cast("double")


def _rms() -> Column:
    return F.sqrt(_energy_total() / F.col("n")) / FULL_SCALE


def sample_sums(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One pass with map-side partial aggregation over exploded samples."""
    s = F.col("s24").cast("bigint")
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("s24").alias("min_sample"), F.max("s24").alias("max_sample"), F.sum(s).alias("total"),
        F.count_if(s == 0).alias("zeros"), F.count_if((s >= FULL_SCALE - 1) | (s <= -FULL_SCALE)).alias("clipped"),
        *_energy(s * s),
    )


def track_statistics(samples: DataFrame, keys: list[str] = ["track_id"], silence: float = SILENCE_RMS) -> DataFrame:
    """Min, max, RMS, peak, DC offset, zero and clip ratio, dBFS and likely silence per track."""
    peak = F.greatest(F.abs("min_sample"), F.abs("max_sample")) / FULL_SCALE
    return sample_sums(samples, keys).withColumn("r", _rms()).select(
        *keys, "n", "min_sample", "max_sample", F.round("r", 6).alias("rms"), F.round(peak, 6).alias("peak"),
        F.round(F.col("total") / F.col("n") / FULL_SCALE, 6).alias("dc_offset"),
        F.round(F.col("zeros") / F.col("n"), 6).alias("zero_ratio"),
        F.round(F.col("clipped") / F.col("n"), 6).alias("clip_ratio"),
        F.round(F.when(F.col("r") > 0, 20 * F.log10("r")), 4).alias("dbfs"),
        (F.col("r") < silence).alias("likely_silent"),
    )


def loudest_pair(samples: DataFrame) -> DataFrame:
    """The two loudest tracks of each clip as monitor left and right.

    Ranked after aggregation: a clip has a handful of tracks by then.
    """
    loud = sample_sums(samples, ["clip_id", "track_id"]).withColumn("r", _rms())
    by_loudness = Window.partitionBy("clip_id").orderBy(F.desc("r"), "track_id")
    top = loud.withColumn("place", F.row_number().over(by_loudness)).where("place <= 2")
    pick = lambda p: F.max(F.when(F.col("place") == p, F.col("track_id")))
    return top.groupBy("clip_id").agg(pick(1).alias("monitor_left"), pick(2).alias("monitor_right"))


def block_positions(blocks: DataFrame, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Blocks of a track in order with their number and first sample."""
    placed = ordered_scan(
        blocks.withColumn("length", F.size("samples").cast("bigint")), ["track_id"], ["block_no"],
        div("block_no", chunk_width), rank="_n", sums={"_end": F.col("length")},
    )
    return placed.select(
        "track_id", "block_no", (F.col("_n") - 1).alias("block_index"), (F.col("_end") - F.col("length")).alias("start_sample"),
        "length", "samples")


def loudest_range(samples: DataFrame, blocks_per_range: int, chunk_width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Best start of a range of n whole blocks per track by RMS; the earliest wins a tie.

    Energy and samples are summed along the blocks once. A range is the difference of two of these sums, n blocks apart:
    each block gives the sum before it to the range that it begins and the sum up to it to the range that it ends. So the
    cost does not depend on n, and a long track is spread over its ranks.
    """
    s = F.col("s24").cast("bigint")
    energy = samples.groupBy("track_id", "block_no").agg(F.sum(s * s).alias("energy"), F.count("*").alias("n"))
    summed = ordered_scan(
        energy, ["track_id"], ["block_no"], div("block_no", chunk_width), rank="rank",
        sums={"e": F.col("energy").cast("decimal(38,0)"), "m": F.col("n")})
    ends = F.array(
        F.struct(F.col("rank").alias("at"), F.col("block_no").alias("block"), (F.col("energy") - F.col("e")).cast("decimal(38,0)").alias("e"), (F.col("n") - F.col("m")).alias("m")),
        F.struct((F.col("rank") - blocks_per_range + 1).alias("at"), F.lit(None).cast("bigint").alias("block"), F.col("e").cast("decimal(38,0)").alias("e"), F.col("m")))
    ranges = summed.select("track_id", F.explode(ends).alias("x")).select("track_id", "x.*").groupBy("track_id", "at").agg(
        F.max("block").alias("block_no"), F.sum("e").alias("e"), F.sum("m").alias("samples"), F.count("*").alias("ends"))
    mean = F.col("e").cast("double") / F.col("samples")
    # One row per track leaves each task: the comparison is an aggregate, not a global sort.
    return ranges.where("ends = 2").withColumn("mean", mean).groupBy("track_id").agg(
        F.max_by(F.struct("block_no", "mean"), F.struct("mean", -F.col("at"))).alias("best")
    ).select("track_id", F.col("best.block_no").alias("start_block"),
             F.round(F.sqrt("best.mean") / FULL_SCALE, 6).alias("rms"))


def interleave(placed: DataFrame, channels: int, grid: int = SAMPLES_PER_CELL) -> DataFrame:
    """Channels of a clip side by side: (clip_id, sample, short, values), one value for each expected channel in order.

    Rows are blocks (clip_id, channel, start_sample, length, samples) with channels from 0. Blocks are cut at a grid of
    samples and meet by (clip, grid cell), so the channels' own block cuts do not matter and a long clip is spread. A
    channel that is missing at a sample, or whose blocks leave a gap or overlap in the cell, is null there; ``short``
    marks the samples with a null. Channels beyond the expected ones are left out.
    """
    c = F.col
    end = c("start_sample") + c("length")
    cut = placed.where((c("length") > 0) & (c("channel") < channels)).withColumn(
        "cell", F.explode(F.sequence(div("start_sample", grid), div(end - 1, grid))))
    begin, stop = F.greatest("start_sample", c("cell") * grid), F.least(end, (c("cell") + 1) * grid)
    part = F.struct(
        (begin - c("cell") * grid).cast("int").alias("at"),
        F.slice("samples", (begin - c("start_sample") + 1).cast("int"), (stop - begin).cast("int")).alias("s"))
    track = cut.groupBy("clip_id", "cell", "channel").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joins = F.forall(
        F.sequence(F.lit(1), F.size("parts")),
        lambda i: (i == F.size("parts")) | (F.get("parts", i)["at"] == F.get("parts", i - 1)["at"] + F.size(F.get("parts", i - 1)["s"])))
    track = track.where(joins).select(
        "clip_id", "cell", F.struct("channel", c("parts")[0]["at"].alias("at"), F.flatten(F.transform("parts", lambda x: x["s"])).alias("s")).alias("t"))
    cells = track.groupBy("clip_id", "cell").agg(F.collect_list("t").alias("ch"), F.max(c("t.at") + F.size("t.s")).alias("n"), F.min("t.at").alias("lo"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: F.get(F.filter("ch", lambda x: x["channel"] == k), F.lit(0)))
    row = lambda i: F.transform("slots", lambda x: F.when(i >= x["at"], F.get(x["s"], i - x["at"])))
    rows = cells.withColumn("slots", slots).select(
        "clip_id", "cell", "lo", F.posexplode(F.transform(F.sequence(c("lo"), c("n") - 1), row)).alias("i", "values"))
    return rows.select(
        "clip_id", (c("cell") * grid + c("lo") + c("i")).alias("sample"), F.exists("values", lambda v: v.isNull()).alias("short"), "values")


def route(rows: DataFrame, mode: str) -> DataFrame:
    """Interleaved rows with the channels of an output mode, in its order; samples without one of these are left out."""
    picked = F.array(*[F.get("values", F.lit(ch)) for ch in ROUTES[mode]]).cast("array<int>")
    return rows.select("clip_id", "sample", F.lit(mode).alias("mode"), picked.alias("values")).where(
        F.forall("values", lambda v: v.isNotNull()))


def byte_readings(sample: Column) -> dict[str, Column]:
    """The same three bytes as signed little-endian, signed big-endian and unsigned little-endian."""
    u = sample.bitwiseAND(F.lit(0xFFFFFF))
    big = F.shiftleft(u.bitwiseAND(F.lit(0xFF)), 16).bitwiseOR(u.bitwiseAND(F.lit(0xFF00))).bitwiseOR(F.shiftright(u, 16))
    return {"s24le": sample, "s24be": F.when(big >= FULL_SCALE, big - 2 * FULL_SCALE).otherwise(big), "u24le": u}


def reading_comparison(samples: DataFrame) -> DataFrame:
    """Statistics of each reading side by side per track."""
    read = samples.select("track_id", *[e.alias(n) for n, e in byte_readings(F.col("s24")).items()])
    cols = [f(n).alias(f"{l}_{n}") for n in ("s24le", "s24be", "u24le") for f, l in ((F.min, "min"), (F.max, "max"))]
    means = [F.round(F.sum(F.col(n).cast("bigint")) / F.count("*"), 4).alias(f"mean_{n}") for n in ("s24le", "s24be", "u24le")]
    return read.groupBy("track_id").agg(*cols, *means)


# The prime of the content digest and its two bases.
DIGEST_PRIME, DIGEST_BASES = (1 << 31) - 1, (48271, 69621)


#: Bits of a position that one table of powers covers.
POWER_BITS = 8


def _power(base: int, pos: Column) -> Column:
    """base ^ pos modulo the prime: one power from a table for each byte of the position, multiplied."""
    out = F.lit(1).cast("bigint")
    for shift in range(0, 32, POWER_BITS):
        powers = ",".join(f"{pow(base, k << shift, DIGEST_PRIME)}L" for k in range(1 << POWER_BITS))
        byte = F.shiftright(pos, shift).bitwiseAND(F.lit((1 << POWER_BITS) - 1)).cast("int")
        out = out * F.get(F.expr(f"array({powers})"), byte) % DIGEST_PRIME
    return out


def _term(base: int, pos: Column, s24: Column) -> Column:
    """What a sample adds to its block's digest: its value, from 1 up, weighted by its position."""
    return (s24.cast("bigint") + (FULL_SCALE + 1)) * _power(base, pos) % DIGEST_PRIME


def _joined(sums: list[Column]) -> Column:
    return sums[0] % DIGEST_PRIME * (1 << 31) + sums[1] % DIGEST_PRIME


def digest_from_samples(samples: DataFrame) -> DataFrame:
    """(track_id, block_no, samples, digest) from single samples in any arrival order, to tell blocks that may differ.

    The digest is a polynomial in two bases modulo a prime, 62 bits in all: a sum over samples of value times a power of the
    base by position. So it is order-sensitive, and yet adds up in any order and is combined before the shuffle: a block
    sends one row a task, not its samples.
    """
    terms = [F.sum(_term(b, F.col("pos").cast("bigint"), F.col("s24"))).alias(f"_d{i}") for i, b in enumerate(DIGEST_BASES)]
    summed = samples.groupBy("track_id", "block_no").agg(F.count("*").alias("samples"), *terms)
    return summed.select("track_id", "block_no", "samples", _joined([F.col("_d0"), F.col("_d1")]).alias("digest"))


def block_digest(blocks: DataFrame) -> DataFrame:
    """MD5 of each whole block's samples in order, as decimal numbers joined by commas; without a shuffle."""
    text = F.array_join(F.transform(to_s24(F.col("samples")), lambda x: x.cast("string")), ",")
    return blocks.select("track_id", "block_no", F.md5(text).alias("digest"))


def content_from_samples(samples: DataFrame) -> DataFrame:
    """The same MD5 from single samples in any arrival order; a group is one block, which is one row at its source."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "s24")))
    text = F.array_join(F.transform(ordered, lambda x: x["s24"].cast("string")), ",")
    return samples.groupBy("track_id", "block_no").agg(F.md5(text).alias("digest"))


def path_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two derivations of the same samples (track_id, block_no, pos, s24), counted per track.

    Blocks whose digests and counts agree are equal throughout; only samples of the other blocks are matched one by one.
    """
    block = ["track_id", "block_no"]
    sides = [digest_from_samples(d).select(*block, F.col("samples").alias(f"n{k}"), F.col("digest").alias(f"d{k}")) for k, d in (("a", a), ("b", b))]
    told = stage(sides[0].join(sides[1], block, "full_outer").withColumn(
        "same", F.coalesce((F.col("na") == F.col("nb")) & (F.col("da") == F.col("db")), F.lit(False))), "digests")
    whole = told.where("same").groupBy("track_id").agg(F.sum("na").alias("compared"), F.sum("na").alias("equal"))
    apart = told.where("not same").select(*block)
    keys = [*block, "pos"]
    left = a.join(apart, block, "left_semi").select(*keys, F.col("s24").alias("va"), F.lit(True).alias("in_a"))
    right = b.join(apart, block, "left_semi").select(*keys, F.col("s24").alias("vb"), F.lit(True).alias("in_b"))
    here = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    single = left.join(right, keys, "full_outer").groupBy("track_id").agg(
        F.count("*").alias("compared"),
        F.count_if(here & F.col("va").eqNullSafe(F.col("vb"))).alias("equal"),
        F.count_if(here & ~F.col("va").eqNullSafe(F.col("vb"))).alias("different"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"))
    counts = ("compared", "equal", "different", "only_a", "only_b")
    both = whole.unionByName(single, allowMissingColumns=True)
    return both.groupBy("track_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts])
