"""Audio statistics, layout and equivalence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as au
from .registry import query

c = F.col

STATS = """n, min_sample, max_sample, round(r, 6) as rms, round(greatest(abs(min_sample), abs(max_sample)) / 8388608.0::double, 6) as peak,
  round(total::double / n / 8388608, 6) as dc_offset, round(zeros::double / n, 6) as zero_ratio,
  round(clipped::double / n, 6) as clip_ratio, round(case when r > 0 then 20 * log10(r) end, 4) as dbfs, r < 0.0001 as likely_silent"""
SUMS = """count(*) as n, min(s24) as min_sample, max(s24) as max_sample, sum(s24::bigint) as total, count(*) filter (s24 = 0) as zeros,
  count(*) filter (s24 >= 8388607 or s24 <= -8388608) as clipped, sqrt(sum(s24::bigint * s24)::double / count(*)) / 8388608 as r"""


@query("a2_track_statistics", ["pcm_sample"], f"""
, s as (select track_id, {SUMS} from pcm_sample group by track_id) select track_id, {STATS} from s""")
def a2(pcm_sample):
    return au.track_statistics(pcm_sample)


@query("k1_loudest_pair", ["pcm_sample"], """
, s as (select block_no % 7 as clip_id, track_id, sqrt(sum(s24::bigint * s24)::double / count(*)) as r from pcm_sample group by all),
p as (select *, row_number() over (partition by clip_id order by r desc, track_id) as place from s)
select clip_id, max(case when place = 1 then track_id end) as monitor_left, max(case when place = 2 then track_id end) as monitor_right
from p group by clip_id""")
def k1(pcm_sample):
    return au.loudest_pair(pcm_sample.withColumn("clip_id", c("block_no") % 7))


@query("w8_loudest_range", ["pcm_sample"], """
, e as (select track_id, block_no, sum(s24::bigint * s24) as energy, count(*) as n from pcm_sample group by all),
w as (select track_id, block_no, sum(energy) over f::double / sum(n) over f as m, count(*) over f as blocks from e
  window f as (partition by track_id order by block_no rows between current row and 4 following)),
b as (select *, row_number() over (partition by track_id order by m desc, block_no) as place from w where blocks = 5)
select track_id, block_no as start_block, round(sqrt(m) / 8388608, 6) as rms from b where place = 1""")
def w8(pcm_sample):
    return au.loudest_range(pcm_sample, 5)


INTER = """, st as (select track_id, block_no, sum(len(samples)) over (partition by track_id order by block_no) - len(samples) as start_sample
  from pcm_block),
g as (select cast(track_id // 5 as bigint) as clip_id, cast(start_sample + pos as bigint) as sample, track_id % 5 as ch, s24
  from pcm_sample join st using (track_id, block_no)),
rows_ as (select clip_id, sample, count(*) < 5 as short, ["""+", ".join(f"max(s24) filter (ch = {k})" for k in range(5))+"""] as v from g group by all)"""


def _placed(pcm_block):
    """Two clips of five channels each."""
    return au.block_positions(pcm_block).withColumns({
        "samples": au.to_s24(c("samples")), "clip_id": F.floor(c("track_id") / 5), "channel": c("track_id") % 5})




@query("v7_interleave", ["pcm_block", "pcm_sample"], INTER + """
select clip_id, sample, short, array_to_string(list_transform(v, lambda x: coalesce(cast(x as varchar), '-')), ',') as sample_values from rows_""")
def v7(pcm_block, pcm_sample):
    return au.interleave(_placed(pcm_block), 5).select(
        "clip_id", "sample", "short", F.array_join("values", ",", "-").alias("sample_values"))


@query("v8_scale_clamp", ["pcm_sample"], """
select track_id, block_no, pos, greatest(least(s24 * 3 / 8388608.0::double, 1.0), -1.0) as value from pcm_sample""")
def v8(pcm_sample):
    return pcm_sample.select("track_id", "block_no", "pos", au.scaled(c("s24") * 3).alias("value"))


@query("v9_byte_readings", ["pcm_sample"], """
, u as (select track_id, s24, s24 & 16777215 as u from pcm_sample),
b as (select *, ((u & 255) << 16) | (u & 65280) | (u >> 16) as b from u),
r as (select track_id, s24 as s24le, case when b >= 8388608 then b - 16777216 else b end as s24be, u as u24le from b)
select track_id, min(s24le) as min_s24le, max(s24le) as max_s24le, min(s24be) as min_s24be, max(s24be) as max_s24be,
  min(u24le) as min_u24le, max(u24le) as max_u24le, round(sum(s24le)::double / count(*), 4) as mean_s24le,
  round(sum(s24be)::double / count(*), 4) as mean_s24be, round(sum(u24le)::double / count(*), 4) as mean_u24le
from r group by track_id""")
def v9(pcm_sample):
    return au.reading_comparison(pcm_sample)


@query("v11_output_routing", ["pcm_block", "pcm_sample"], INTER + """
select clip_id, sample, 'monitor' as mode, concat(v[4], ',', v[1]) as sample_values from rows_ where v[4] is not null and v[1] is not null
union all select clip_id, sample, 'four-mono', concat(v[1], ',', v[2], ',', v[3], ',', v[4]) from rows_
  where v[1] is not null and v[2] is not null and v[3] is not null and v[4] is not null
union all select clip_id, sample, 'none', '' from rows_""")
def v11(pcm_block, pcm_sample):
    rows = au.interleave(_placed(pcm_block), 5)
    out = au.route(rows, "monitor").unionByName(au.route(rows, "four-mono")).unionByName(au.route(rows, "none"))
    return out.select("clip_id", "sample", "mode", F.array_join("values", ",").alias("sample_values"))


@query("j15_path_equivalence", ["pcm_block", "pcm_sample"], """
, b as (select track_id, block_no, pos, case when block_no % 43 = 0 and pos = 7 then s24 + 1 else s24 end as s24 from pcm_sample
  where not (block_no % 41 = 0 and pos = 5))
select track_id, count(*) as compared, count(*) filter (b.pos is not null and a.s24 = b.s24) as equal,
  count(*) filter (b.pos is not null and a.s24 <> b.s24) as different, count(*) filter (b.pos is null) as only_a,
  cast(0 as bigint) as only_b from pcm_sample a left join b using (track_id, block_no, pos) group by track_id""")
def j15(pcm_block, pcm_sample):
    direct = pcm_block.select("track_id", "block_no", F.posexplode(au.to_s24(c("samples"))).alias("pos", "s24"))
    # Planted: the second path misses one sample in some blocks and reads another one wrong.
    other = pcm_sample.where("not (block_no % 41 = 0 and pos = 5)").withColumn(
        "s24", F.when((c("block_no") % 43 == 0) & (c("pos") == 7), c("s24") + 1).otherwise(c("s24")))
    return au.path_equivalence(direct, other)


@query("a17_content_digest", ["pcm_block", "pcm_sample"], """
, d as (select track_id, block_no, md5(string_agg(s24::varchar, ',' order by pos)) as digest from pcm_sample group by all)
select track_id, block_no, digest, block_no % 37 <> 0 as equal from d""")
def a17(pcm_block, pcm_sample):
    # Planted: one block in 37 has its first sample off by one on the second path.
    off = (c("block_no") % 37 == 0) & (c("pos") == 0)
    second = pcm_sample.withColumn("s24", F.when(off, c("s24") + 1).otherwise(c("s24")))
    other = au.content_from_samples(second).withColumnRenamed("digest", "second")
    return au.block_digest(pcm_block).join(other, ["track_id", "block_no"]).select(
        "track_id", "block_no", "digest", (c("digest") == c("second")).alias("equal"))
