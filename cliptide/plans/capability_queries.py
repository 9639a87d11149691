"""Capability matching, devices, messages, resources and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capability as cap
from .registry import query

c = F.col
VIEWS = ["decoder_request", "capability", "capability_format"]

# The naive form: every request against every capability it could meet, kept to distinct shapes so that
# DuckDB stays within memory at larger scale.
MATCH = """
, u as (select distinct codec, scan, profile, bit_depth, chroma, max_width, max_height, backend from
    (select *, 'progressive' as scan from capability where progressive union all select *, 'interlaced' from capability where interlaced) a
  where exists (select 1 from capability_format f where f.capability_id = a.capability_id and f.bit_depth = a.bit_depth and f.chroma = a.chroma)),
q as (select distinct codec, scan, profile, bit_depth, chroma, width, height from decoder_request),
m as (select q.*, coalesce(bool_or(u.backend = 'hardware'), false) as hardware, coalesce(bool_or(u.backend = 'software'), false) as software
  from q left join u on u.codec = q.codec and u.scan = q.scan and u.profile = q.profile and u.bit_depth = q.bit_depth
    and u.chroma = q.chroma and q.width <= u.max_width and q.height <= u.max_height group by all),
r as (select request_id, hardware, software, case when hardware then 'hardware' when software then 'software' else 'unsupported' end
  as backend from decoder_request join m using (codec, scan, profile, bit_depth, chroma, width, height))"""


@query("j10_capability_match", VIEWS, MATCH + "select request_id, hardware or software as satisfied from r")
def j10(decoder_request, capability, capability_format):
    return cap.match_requests(decoder_request, capability, capability_format).select(
        "request_id", (c("hardware") | c("software")).alias("satisfied"))


@query("j11_unsupported_requests", VIEWS, MATCH + "select request_id from r where backend = 'unsupported'")
def j11(decoder_request, capability, capability_format):
    return cap.match_requests(decoder_request, capability, capability_format).where(
        "backend = 'unsupported'").select("request_id")


@query("j12_backend_fallback", VIEWS, MATCH + "select request_id, backend from r")
def j12(decoder_request, capability, capability_format):
    return cap.match_requests(decoder_request, capability, capability_format).select("request_id", "backend")


@query("j13_request_response", ["message_log"], """
, a as (select session_id, request_id, count(*) as responses, min(seq) as first_response from message_log where kind = 'response' group by all)
select q.session_id, cast(q.request_id as bigint) as request_id, q.opcode, q.seq, coalesce(responses, 0) as responses, first_response
from message_log q left join a on a.session_id = q.session_id and a.request_id = q.request_id where q.kind = 'request'""", settle=["message_log"])
def j13(message_log):
    return cap.replies(message_log)


@query("j13_reply_summary", ["message_log"], """
, a as (select session_id, request_id, count(*) as n, count(*) filter (payload_len % 7 = 0) as bad from message_log
  where kind = 'response' group by all)
select opcode, count(*) as requests, count(*) filter (n is null) as unanswered, round(sum(bad)::double / nullif(sum(n), 0), 6) as error_share
from message_log q left join a on a.session_id = q.session_id and a.request_id = q.request_id where q.kind = 'request' group by opcode""", settle=["message_log"])
def j13_summary(message_log):
    return cap.reply_summary(message_log, c("payload_len") % 7 == 0)


@query("k2_device_preference", ["capability"], """
, r as (select device, capability_id, case when preferred_vendor and device_class = 'integrated' then 0
    when device_class = 'integrated' then 1 when device_class = 'discrete' then 2 end as rank,
    row_number() over (partition by device order by rank nulls last, capability_id) as place from capability)
select device, case when rank is not null then capability_id end as capability_id,
  case when rank is null then 'no device advertised' else 'ok' end as status from r where place = 1""")
def k2(capability):
    return cap.preferred_device(capability, "device")


@query("a14_live_at_disconnect", ["resource_log"], """
, o as (select session_id, resource_id, count(*) filter (op = 'create') as made, count(*) filter (op = 'destroy') as gone
  from resource_log group by all)
select session_id, count(*) filter (made > gone) as live from o group by session_id having count(*) filter (made > gone) > 0""")
def a14(resource_log):
    return cap.live_at_disconnect(resource_log)


@query("r7_resource_ownership", ["resource_log"], """
, log2 as (select * from resource_log union all
  select session_id, resource_id, op, seq + 1000000 from resource_log where op = 'destroy' and resource_id % 9 = 0 union all
  select session_id, resource_id, 'use', case when resource_id % 2 = 0 then seq + 500000 else seq - 1 end from resource_log
    where op = 'destroy' and resource_id % 7 = 0),
e as (select *, count(*) filter (op = 'create') over w as life, last_value(case when op = 'create' then session_id end ignore nulls) over w as owner
  from log2 window w as (partition by resource_id order by seq, op, session_id rows unbounded preceding)),
d as (select *, count(*) filter (op = 'destroy' and session_id = owner) over (partition by resource_id, life
    order by seq, op, session_id rows unbounded preceding) as ends from e)
select session_id, resource_id, op, seq, case when op = 'create' then 'ok' when owner is null then 'unknown-resource'
  when session_id <> owner then 'not-owner' when ends > case when op = 'destroy' then 1 else 0 end then 'already-destroyed' else 'ok' end as outcome from d""")
def r7(resource_log):
    # Planted: one destroy in nine is repeated later, and one resource in seven is used by whoever destroys it, every
    # second time after that.
    again = resource_log.where("op = 'destroy' and resource_id % 9 = 0").withColumn("seq", c("seq") + 1000000)
    use = resource_log.where("op = 'destroy' and resource_id % 7 = 0").withColumns({
        "op": F.lit("use"), "seq": F.when(c("resource_id") % 2 == 0, c("seq") + 500000).otherwise(c("seq") - 1)})
    return cap.ownership_audit(resource_log.unionByName(again).unionByName(use))


@query("a15_evidence_rollup", ["evidence"], f"""
, t as (select subsystem, max(level_rank) as level_rank, count(*) as facts from evidence group by subsystem)
select subsystem, level_rank, facts, {list(cap.EVIDENCE_LEVELS)}[level_rank + 1] as level, level_rank = 0 as not_implemented from t""")
def a15(evidence):
    return cap.evidence_rollup(evidence)
