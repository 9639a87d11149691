"""The adapter views as DuckDB SQL, used only as common table expressions of the oracle queries."""

from __future__ import annotations

VIEWS = {
    "command_log": """
select session_id, seq, command_id, ts,
  case when k % 4 <> 0 then case (seq - 1) % 12 when 0 then 'LoadPreparedInput' when 1 then 'Prepare' when 2 then 'Cue'
      when 3 then 'Preroll' when 4 then 'Play' when 5 then 'Play' when 6 then 'Pause' when 7 then 'Seek'
      when 8 then 'Preroll' when 9 then 'Play' when 10 then 'Stop' else 'Unload' end
    else case k % 10 when 0 then 'Snapshot' when 2 then 'Play' when 4 then 'Seek' when 6 then 'Cue' else 'Pause' end
    end as command,
  10 + cast(floor(value) as bigint) % 100 as frame,
  case when k % 3 = 0 then cast(k % 5 as bigint) end as frame_count,
  case when k % 29 = 0 then cast(999999 as bigint) end as expected_generation
from (select user_id as session_id, event_id as command_id, ts, value,
        cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
        row_number() over (partition by user_id order by ts, event_id) as seq
      from events) e
""",
    "packet": """
select clip_id, channel, essence_key, packet_no, payload_len, bit_depth, picture, is_sync, duration, composition_offset,
  cast(sum(payload_len + 20) over (partition by clip_id order by packet_no) - payload_len - 20 as bigint) as file_offset
from (select l_suppkey as clip_id, cast(l_linenumber % 4 as int) as channel,
        case when l_linenumber <= 4 then concat('pcm.', cast(l_linenumber % 4 as varchar(2))) when l_linenumber = 5 then 'avc.1'
          when l_linenumber = 6 then 'part.body' else 'fill' end as essence_key,
        row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as packet_no,
        cast(l_quantity as bigint) * 3 + case when l_orderkey % 97 = 0 then 1 else 0 end as payload_len,
        24 as bit_depth,
        case l_returnflag when 'A' then 'I' when 'R' then 'P' else 'B' end as picture,
        l_returnflag = 'A' and l_linestatus = 'F' as is_sync,
        cast(1 as bigint) as duration, cast(l_linenumber - 3 as bigint) as composition_offset
      from lineitem) p
""",
    "picture": """
select clip_id, n as decode_no, n % 480 = 0 as idr, reference, cast(floor(n / 480) as bigint) as segment_true,
  (2 * (n % 480) + case when reference then 0 else 3 end) % 256 as poc_lsb,
  2 * (n % 480) + case when reference then 0 else 3 end as poc_true
from (select clip_id, packet_no - 1 as n, picture <> 'B' or (packet_no - 1) % 480 = 0 as reference from packet) q
""",
    "pcm_block": """
select label as track_id, vec_id as block_no, embedding as samples from embeddings
""",
    "pcm_sample": """
select label as track_id, vec_id as block_no, cast(i - 1 as int) as pos,
  cast(floor(cast(embedding[i] as double) * 8388608) as int) as s24
from (select label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) u
""",
    "clip": """
select o_orderkey as clip_id, o_custkey as project_id,
  concat('media://local/source/', cast(o_orderkey as varchar(20))) as public_uri,
  case o_orderpriority when '1-URGENT' then 50 when '2-HIGH' then 25 when '3-MEDIUM' then 30000
    when '4-NOT SPECIFIED' then 60000 else 24000 end as rate_num,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 1001 end as rate_den,
  cast(floor(o_totalprice) as bigint) % 60 as duration_frames,
  o_orderkey % 20 as range_start, o_orderkey % 20 + o_custkey % 40 as range_end,
  case o_orderstatus when 'O' then 'Original' when 'P' then 'ProxyIfAvailable' else 'Proxy' end as playback_input,
  o_orderkey % 5 <> 0 as proxy_available, 48000 as sample_rate, 24 as bit_depth,
  cast(o_custkey % 5 as int) as lane_count,
  case when o_orderkey % 97 = 0 then '/srv/media/original.mxf' else concat('opaque-', cast(o_orderkey as varchar(20))) end as binding_ref,
  case when o_orderkey % 89 = 0 then 'ProxyAac' else 'Original' end as audio_authority,
  case when o_custkey % 2 = 0 then 1920 else 1280 end as width, case when o_custkey % 2 = 0 then 1080 else 720 end as height,
  case when o_custkey % 3 = 0 then 10 else 8 end as video_depth, case when o_custkey % 3 = 0 then '4:2:2' else '4:2:0' end as chroma
from orders
""",
    "ranged_log": """
select l.*, cast(coalesce(c.range_start, 10) as bigint) as range_start, cast(coalesce(c.range_end, 90) as bigint) as range_end
from command_log l left join clip c on c.clip_id = l.session_id
""",
    "prepared": """
select * replace (case when clip_id % 37 = 8 then range_start else range_end end as range_end,
    case when clip_id % 37 = 9 then 'Unknown' else audio_authority end as audio_authority),
  case when clip_id % 37 = 1 then ' ' else '1.0' end as contract_version,
  case when clip_id % 37 = 5 then '/srv/media/source' else concat('source-', cast(clip_id as varchar)) end as source_id,
  case when clip_id % 37 = 2 then 'http://workspace/db' else 'media://local/workspace' end as workspace_uri,
  case when clip_id % 37 = 3 then concat('media://local', chr(92), 'original') when clip_id % 2 = 1 then null else concat('media://local/original/', cast(clip_id as varchar)) end as original_media_id,
  case when clip_id % 37 = 4 then 'media://local/file:/proxy' when clip_id % 3 = 1 then null else concat('media://local/proxy/', cast(clip_id as varchar)) end as proxy_media_id,
  clip_id % 37 = 6 as private_path_exposed,
  case when clip_id % 37 = 7 then 'file:/srv/proxy.mp4' when clip_id % 7 = 3 then null else 'opaque-proxy' end as proxy_binding_ref,
  clip_id % 7 <> 5 as proxy_bound
from clip
""",
    "proxy": """
select case when clip_id % 11 = 0 then clip_id + 100000000 else clip_id end as clip_id,
  case when clip_id % 3 = 0 then rate_num * 2 else rate_num end as rate_num,
  case when clip_id % 3 = 0 then rate_den * 2 else rate_den end as rate_den,
  duration_frames + case when clip_id % 7 = 0 then 1 else 0 end as duration_frames,
  case when clip_id % 10 = 1 then 0 when clip_id % 9 = 0 then width + 8 else width end as width, height,
  case when clip_id % 8 = 0 then 10 else video_depth end as video_depth,
  case when clip_id % 6 = 0 then '4:4:4' else chroma end as chroma
from clip where proxy_available
""",
    "frame_decision": """
select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
  value as lateness_ms, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 25 = 0 as duplicated
from events
""",
    "stage_timing": """
select user_id as run_id, event_type as stage, event_id as frame, value as ms from events
""",
    "resource_log": """
select o_custkey as session_id, o_orderkey as resource_id, 'create' as op, o_orderkey * 2 as seq from orders
union all
select case when o_orderkey % 13 = 0 then o_custkey + 1 else o_custkey end, o_orderkey, 'destroy',
  o_orderkey * 2 + 1 + 2 * (o_custkey % 40) from orders where o_orderstatus <> 'P'
""",
    "message_log": """
select conv_id as session_id,
  case when role = 'assistant' then 'response' else 'request' end as kind, role as opcode, turn as seq,
  sum(case when role = 'assistant' then 0 else 1 end) over (partition by conv_id order by turn) as request_id,
  cast(length(text) as bigint) as payload_len
from conversations
""",
    "capability": """
select p_partkey as capability_id, p_brand as device, p_type as profile,
  case when p_partkey % 5 = 4 then 'H265' else 'H264' end as codec, p_partkey % 4 = 3 as interlaced,
  case when p_partkey % 3 = 0 then 10 else 8 end as bit_depth, p_size * 100 as max_width, p_size * 60 as max_height,
  case when p_partkey % 2 = 0 then 'hardware' else 'software' end as backend, p_partkey % 7 <> 0 as progressive,
  case when p_partkey % 3 = 0 then '4:2:2' else '4:2:0' end as chroma,
  case p_partkey % 4 when 0 then 'integrated' when 1 then 'discrete' else 'other' end as device_class,
  p_partkey % 5 = 0 as preferred_vendor
from part
""",
    "capability_format": """
select capability_id, bit_depth, chroma from capability where capability_id % 6 <> 5
""",
    "decoder_request": """
select o_orderkey as request_id,
  case o_custkey % 7 when 0 then 'STANDARD' when 1 then 'ECONOMY' when 2 then 'MEDIUM' when 3 then 'PROMO'
    when 4 then 'SMALL' when 5 then 'LARGE' else 'UNKNOWN' end as profile,
  case when o_orderkey % 4 = 0 then 10 else 8 end as bit_depth,
  case when o_orderkey % 4 = 0 then '4:2:2' else '4:2:0' end as chroma,
  case when o_orderkey % 6 = 5 then 'H265' else 'H264' end as codec,
  case when o_custkey % 8 = 3 then 'interlaced' else 'progressive' end as scan,
  1000 + o_custkey % 45 * 100 as width, 600 + o_custkey % 45 * 60 as height
from orders
""",
    "metadata_node": """
select concat('R', cast(r_regionkey as varchar(20))) as uid, 'Storage' as kind from region
union all select concat('N', cast(n_nationkey as varchar(20))), 'Package' from nation
union all select case when c_custkey % 200 = 7 then null else concat('C', cast(c_custkey as varchar(20))) end, 'Track' from customer
union all select concat('C', cast(c_custkey as varchar(20))), 'Track' from customer where c_custkey % 250 = 3
""",
    "metadata_ref": """
select concat('N', cast(n_nationkey as varchar(20))) as from_uid, concat('R', cast(n_regionkey as varchar(20))) as to_uid from nation
union all select concat('C', cast(c_custkey as varchar(20))),
  concat('N', cast(case when c_custkey % 50 = 0 then c_nationkey + 100 else c_nationkey end as varchar(20))) from customer
""",
    "evidence": """
select user_id % 40 as subsystem, k % 24 as level_rank, k % 2 = 0 as dequeued, k % 3 = 0 as submitted,
  k % 5 = 0 as timed_out, k % 7 as callbacks, k % 11 = 0 as drained, k % 13 = 0 as errored, k % 17 = 0 as configured, event_id
from (select user_id, event_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e
""",
    "open_error": """
select event_id, user_id as clip_id, case k % 8 when 0 then 'MalformedSample' when 1 then 'SampleNormalization' when 2 then 'H264'
  when 3 then 'MissingAvcConfig' when 4 then 'NoVideoSamples' when 5 then 'Io' when 6 then 'TooManySamples'
  else 'TimestampOverflow' end as error_kind
from (select user_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e
where event_type = 'error'
""",
    "transcript": """
select conv_id as session_id, turn as seq, cast(floor(turn / 3) as bigint) as generation, role as kind
from conversations where (conv_id + turn) % 23 <> 5
""",
    "identity": """
select page_id, case when page_id % 17 = 0 then concat('file:', url) when page_id % 19 = 0 then '/srv/media/clip.mxf' else url end as uri
from pages
""",
}

NEEDS = {"picture": ("packet",), "proxy": ("clip",), "prepared": ("clip",), "ranged_log": ("command_log", "clip"), "capability_format": ("capability",)}
