"""Clip rules, metadata graph, validation and string checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions.timing import interval_ns, rates_equal
from ..operators import metadata as md
from .registry import query
from .snippets import EXPOSED, PRIVATE

c = F.col

PICTURE = """case when playback_input = 'Original' then 'Original' when proxy_available then 'Proxy'
  when playback_input = 'ProxyIfAvailable' then 'Original' else 'MissingProxy' end"""
MODE = f"case {PICTURE} when 'Proxy' then 'ProxyPreview' when 'Original' then 'OriginalMedia' else 'MissingProxy' end"


def chosen(clip):
    picture = r.picture_choice(c("playback_input"), c("proxy_available"))
    return clip.withColumn("picture", picture).withColumn("mode", r.source_mode(c("picture")))


@query("p6_cue_validity", ["command_log", "clip"], """
select l.command_id, l.session_id, l.frame, c.range_start < c.range_end and c.range_end <= c.duration_frames as range_ok,
  c.range_start < c.range_end and l.frame >= c.range_start and l.frame < c.range_end as frame_ok
from command_log l join clip c on c.clip_id = l.session_id where l.command in ('Cue', 'Seek')""")
def p6(command_log, clip):
    asked = command_log.where("command in ('Cue', 'Seek')").select(
        "command_id", "session_id", "frame", c("session_id").alias("clip_id"))
    return asked.join(clip.select("clip_id", "range_start", "range_end", "duration_frames"), "clip_id").select(
        "command_id", "session_id", "frame",
        r.range_ok(c("range_start"), c("range_end"), c("duration_frames")).alias("range_ok"),
        r.in_range(c("frame"), c("range_start"), c("range_end")).alias("frame_ok"))


@query("p7_step_clamp", ["command_log"], """
select command_id, session_id, least(greatest(frame + coalesce(frame_count, -3) * 20, 10), 89) as stepped from command_log""")
def p7(command_log):
    delta = F.coalesce("frame_count", F.lit(-3)) * 20
    return command_log.select("command_id", "session_id", r.step_frame(c("frame"), delta, F.lit(10), F.lit(90)).alias("stepped"))


@query("p8_preview_decimation", ["frame_decision"], """
select run_id, frame, case when frame % 2 = 0 then 'selected' else 'intentional-skip' end as label from frame_decision""")
def p8(frame_decision):
    return frame_decision.select("run_id", "frame", r.decimation(c("frame"), 2).alias("label"))


@query("p9_tick_sampling", ["command_log"], """
select session_id, seq, case when seq % 25 = 0 then 'emit' else 'skipped' end as label from command_log""")
def p9(command_log):
    return command_log.select("session_id", "seq", r.tick_label(c("seq"), 25).alias("label"))


@query("p10_presentation_decision", ["frame_decision"], """
select run_id, frame, case when lateness_ms <= 5 then 'OnTime' when lateness_ms <= 40 then 'Late' else 'Dropped' end as decision
from frame_decision""")
def p10(frame_decision):
    return frame_decision.select("run_id", "frame", r.presentation(c("lateness_ms")).alias("decision"))


@query("p11_health_class", ["open_error"], """
, h as (select clip_id, case when error_kind in ('MalformedSample', 'SampleNormalization', 'H264') then 'DamagedUnrecoverable'
  when error_kind in ('MissingAvcConfig', 'NoVideoSamples') then 'ValidButUnsupported' else 'FatalContainerError' end as health
  from open_error)
select clip_id, health, count(*) as errors from h group by all""")
def p11(open_error):
    return open_error.withColumn("health", r.health_class(c("error_kind"))).groupBy("clip_id", "health").agg(
        F.count("*").alias("errors"))


@query("p12_submission_evidence", ["evidence"], """
select event_id, case when errored then 'StreamErrorAfterSubmit' when drained then 'DrainCompleted'
  when callbacks > 0 then 'PostSubmitCallbackObserved' when timed_out then 'PostSubmitTimeout'
  when submitted then 'BufferSubmitted' when dequeued then 'BufferDequeued' when configured then 'NativeStreamConfigured'
  else 'NativeStreamCreated' end as level from evidence""")
def p12(evidence):
    flags = ("errored", "drained", "callbacks", "timed_out", "submitted", "dequeued", "configured")
    return evidence.select("event_id", r.submission_evidence(*map(c, flags)).alias("level"))


@query("p13_input_agreement", ["clip"], """
, s as (select *, case when clip_id % 2 = 0 then 'ProxyPreview' else 'OriginalMedia' end as mode,
  case when clip_id % 3 = 0 then 'Proxy' else 'Original' end as picture from clip)
select clip_id, case when playback_input = 'Original' then mode = 'OriginalMedia' and picture = 'Original'
  when playback_input = 'Proxy' then proxy_available and mode = 'ProxyPreview' and picture = 'Proxy'
  when proxy_available then mode = 'ProxyPreview' and picture = 'Proxy'
  else mode = 'OriginalMedia' and picture = 'Original' end as agrees from s""")
def p13(clip):
    mode = F.when(c("clip_id") % 2 == 0, "ProxyPreview").otherwise("OriginalMedia")
    picture = F.when(c("clip_id") % 3 == 0, "Proxy").otherwise("Original")
    return clip.select("clip_id", r.input_agrees(c("playback_input"), c("proxy_available"), mode, picture).alias("agrees"))


@query("p14_picture_mode", ["clip"], f"select clip_id, {PICTURE} as picture, {MODE} as mode from clip")
def p14(clip):
    return chosen(clip).select("clip_id", "picture", "mode")


@query("p18_lane_labels", ["clip"], """
select clip_id, cast(lane as int) as lane, concat('A', cast(lane + 1 as varchar)) as label
from (select clip_id, unnest(range(0, lane_count)) as lane from clip where lane_count > 0) l""")
def p18(clip):
    lanes = clip.where("lane_count > 0").select(
        "clip_id", F.explode(F.sequence(F.lit(0), c("lane_count") - 1)).alias("lane"))
    return lanes.withColumn("label", r.lane_label(c("lane")))


@query("p19_fallback_chain", ["clip", "proxy"], """
select c.clip_id, coalesce(p.rate_num, 25) as rate_num, coalesce(p.rate_den, 1) as rate_den,
  coalesce(case when p.clip_id % 2 = 0 then p.duration_frames end, 0) as timecode_start
from clip c left join proxy p using (clip_id)""")
def p19(clip, proxy):
    known = proxy.select("clip_id", "rate_num", "rate_den",
                         F.when(c("clip_id") % 2 == 0, c("duration_frames")).alias("timecode_start"))
    return clip.select("clip_id").join(known, "clip_id", "left").select(
        "clip_id", F.coalesce("rate_num", F.lit(25)).alias("rate_num"), F.coalesce("rate_den", F.lit(1)).alias("rate_den"),
        F.coalesce("timecode_start", F.lit(0).cast("bigint")).alias("timecode_start"))


@query("p20_preroll_readiness", ["command_log"], """
, w as (select session_id, (seq - 1) // 12 as window_no, count(*) filter (command in ('Cue', 'Seek', 'Preroll')) as video,
  count(*) filter (command in ('Play', 'Pause')) as audio, max(frame) < 105 as limits_ok from command_log group by all)
select session_id, window_no, video, audio, case when not limits_ok then 'invalid queue limits'
  when video < 3 and audio < 3 then 'video and audio missing' when video < 3 then 'video missing'
  when audio < 3 then 'audio missing' else 'ready' end as status from w""")
def p20(command_log):
    from ..operators.scan import div
    w = command_log.groupBy("session_id", div(c("seq") - 1, 12).alias("window_no")).agg(
        F.count_if(c("command").isin("Cue", "Seek", "Preroll")).alias("video"),
        F.count_if(c("command").isin("Play", "Pause")).alias("audio"), (F.max("frame") < 105).alias("limits_ok"))
    return w.select("session_id", "window_no", "video", "audio",
                    r.preroll_status(c("video"), c("audio"), 3, 3, c("limits_ok")).alias("status"))


TAGS = """, dim as (select concat('t', cast(level_rank as varchar)) as local_tag, min_by(concat('p', cast(event_id as varchar)), event_id) as property
  from evidence where level_rank <> 7 group by level_rank)"""


@query("j5_tag_resolution", ["evidence"], TAGS + """
select event_id, e.tag as local_tag, property from (select event_id, concat('t', cast(level_rank as varchar)) as tag from evidence) e
left join dim on dim.local_tag = e.tag""")
def j5(evidence):
    tag = F.concat(F.lit("t"), c("level_rank").cast("string")).alias("local_tag")
    mapping = evidence.where("level_rank <> 7").select(
        tag, F.concat(F.lit("p"), c("event_id").cast("string")).alias("property"), c("event_id").alias("position"))
    return md.resolve_tags(evidence.select("event_id", tag), mapping)


@query("j6_dangling_refs", ["metadata_ref", "metadata_node"], """
select from_uid, to_uid from metadata_ref r where not exists (select 1 from metadata_node n where n.uid = r.to_uid)""")
def j6(metadata_ref, metadata_node):
    return md.dangling_refs(metadata_ref, metadata_node)


@query("j7_track_reference", ["metadata_ref", "metadata_node"], """
select from_uid, to_uid from metadata_ref r where exists
  (select 1 from metadata_node n where n.uid = r.to_uid and n.kind = 'Package')""")
def j7(metadata_ref, metadata_node):
    return md.with_known_target(metadata_ref, metadata_node, "Package")


@query("j8_package_tracks", ["customer", "metadata_node"], """
, p as (select concat('C', cast(c_custkey as varchar)) as uid, [concat('N', cast(c_nationkey as varchar)),
    concat('R', cast(c_nationkey % 6 as varchar)), concat('N', cast(c_custkey % 30 as varchar))] as refs from customer),
o as (select uid, unnest(range(0, 3)) as position, unnest(refs) as to_uid from p),
k as (select uid as to_uid, min(kind) as target_kind from metadata_node where uid is not null group by uid)
select o.uid, cast(position as int) as position, o.to_uid, target_kind from o left join k using (to_uid)""")
def j8(customer, metadata_node):
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    packages = customer.select(
        text("C", c("c_custkey")).alias("uid"),
        F.array(text("N", c("c_nationkey")), text("R", c("c_nationkey") % 6), text("N", c("c_custkey") % 30)).alias("refs"))
    return md.resolve_ordered_refs(packages, metadata_node)


@query("j7_untracked_descriptors", ["metadata_ref", "metadata_node"], """
select from_uid, to_uid from metadata_ref r where not exists
  (select 1 from metadata_node n where n.uid = r.from_uid and n.kind = 'Track')""")
def j7_anti(metadata_ref, metadata_node):
    tracks = metadata_node.where("kind = 'Track'").select(c("uid").alias("from_uid"))
    return metadata_ref.join(tracks, "from_uid", "left_anti")


@query("j9_proxy_association", ["clip", "proxy"], """
select coalesce(c.clip_id, p.clip_id) as clip_id, case when c.clip_id is null then 'OriginalMissing' when p.clip_id is null then 'NoProxy'
  when c.rate_num * p.rate_den = p.rate_num * c.rate_den and c.duration_frames = p.duration_frames then 'TimingCompatible'
  else 'Mismatch' end as status from clip c full outer join proxy p on c.clip_id = p.clip_id""")
def j9(clip, proxy):
    return md.associate(clip, proxy)


@query("a7_duplicate_ids", ["metadata_node"], """
select uid, count(*) as copies from metadata_node where uid is not null group by uid having count(*) > 1""")
def a7(metadata_node):
    return md.duplicate_ids(metadata_node)


@query("v5_missing_ids", ["metadata_node"], "select kind, count(*) as missing from metadata_node where uid is null group by kind")
def v5(metadata_node):
    return md.missing_ids(metadata_node)


@query("s4_diagnostics_union", ["metadata_node", "metadata_ref"], """
select 'dangling-reference' as finding, from_uid as subject, to_uid as detail from metadata_ref r
  where not exists (select 1 from metadata_node n where n.uid = r.to_uid)
union all select 'duplicate-id', uid, cast(count(*) as varchar) from metadata_node where uid is not null group by uid having count(*) > 1
union all select 'missing-id', kind, cast(count(*) as varchar) from metadata_node where uid is null group by kind""")
def s4(metadata_node, metadata_ref):
    return md.diagnostics(metadata_node, metadata_ref)


@query("v1_public_uri", ["identity"], """
select page_id, starts_with(uri, 'http://') and not contains(uri, chr(92)) and not contains(uri, 'file:') as public from identity""")
def v1(identity):
    return identity.select("page_id", r.public_uri_ok(c("uri"), "http://").alias("public"))


LONG = " union all ".join(f"select clip_id, '{f}' as field, {f} as text from prepared" for f in PRIVATE)


@query("v2_private_path_audit", ["prepared"], f"""
, f as ({LONG})
select clip_id, field from f where starts_with(text, '/') or contains(text, 'file:')
union all select clip_id, 'private_path_exposed' from prepared where private_path_exposed""")
def v2(prepared):
    return r.path_audit(prepared, "clip_id")


@query("v2_private_path_counts", ["prepared"], f"""
, f as ({LONG})
select field, count(*) filter (starts_with(text, '/') or contains(text, 'file:')) as blocked, count(text) as checked from f group by field""")
def v2_counts(prepared):
    return r.path_counts(prepared)


PUBLIC = "starts_with({0}, 'media://') and not contains({0}, chr(92)) and not contains({0}, 'file:')"
VALID = f"""
, s as (select c.*, {PICTURE} as picture, {MODE} as mode, p.clip_id is not null as has_proxy,
    c.rate_num * p.rate_den = p.rate_num * c.rate_den and c.duration_frames = p.duration_frames as ok_timing
  from prepared c left join proxy p on p.clip_id = c.clip_id)
select clip_id, case when trim(contract_version) = '' or not ({PUBLIC.format('public_uri')}) or not ({PUBLIC.format('workspace_uri')})
    or not coalesce({PUBLIC.format('original_media_id')}, true) or not coalesce({PUBLIC.format('proxy_media_id')}, true)
    then 'missing public source URI'
  when {EXPOSED} then 'private path exposure rejected'
  when audio_authority = 'ProxyAac' then 'proxy AAC cannot be authoritative'
  when audio_authority <> 'Original' then 'missing authoritative original audio'
  when picture = 'MissingProxy' then 'selected picture representation does not match source mode'
  when lane_count = 0 then 'no original audio lanes'
  when lane_count = 4 and clip_id % 5 = 2 then 'stereo collapse is not a valid runtime audio model'
  when lane_count < 2 or duration_frames = 0 then 'invalid project audio'
  when range_start >= range_end then 'invalid active range'
  when mode = 'ProxyPreview' and not coalesce(ok_timing, false) then 'original/proxy timing compatibility unknown'
  when mode = 'ProxyPreview' and (not proxy_bound or proxy_binding_ref is null or not has_proxy) then 'invalid source mode'
  else 'ok' end as outcome from s"""


@query("v3_prepared_validation", ["prepared", "proxy"], VALID)
def v3(prepared, proxy):
    p = proxy.select("clip_id", c("rate_num").alias("pn"), c("rate_den").alias("pd"), c("duration_frames").alias("pf"), F.lit(True).alias("proxy_video"))
    channels = F.when(c("lane_count") > 0, F.sequence(F.lit(0), c("lane_count") - 1)).otherwise(F.array().cast("array<int>"))
    # Planted: a four-lane clip in five has a stereo lane.
    stereo = (c("lane_count") == 4) & (c("clip_id") % 5 == 2)
    lanes = F.transform(r.lanes(channels), lambda x: F.struct(
        x["lane_index"].alias("lane_index"), x["source_channel"].alias("source_channel"),
        F.when(stereo & (x["lane_index"] == 2), "Stereo").otherwise(x["kind"]).alias("kind"),
        x["authoritative"].alias("authoritative")))
    same = rates_equal(c("rate_num"), c("rate_den"), c("pn"), c("pd")) & (c("duration_frames") == c("pf"))
    ready = chosen(prepared).join(p, "clip_id", "left").withColumns({
        "lanes": lanes, "timing_compatible": same, "proxy_aac_authoritative": c("audio_authority") == "ProxyAac",
        "project_channels": F.lit(2), "project_rate": F.lit(48000)})
    return ready.select("clip_id", r.validate_prepared().alias("outcome"))


@query("v4_descriptor_mismatch", ["proxy", "clip"], """
, d as (select p.clip_id, f.field, case f.field when 'width' then p.width::varchar when 'height' then p.height::varchar
    when 'video_depth' then p.video_depth::varchar else p.chroma end as metadata,
  case f.field when 'width' then c.width::varchar when 'height' then c.height::varchar
    when 'video_depth' then c.video_depth::varchar else c.chroma end as essence
  from proxy p join clip c on c.clip_id = p.clip_id, (values ('width'), ('height'), ('video_depth'), ('chroma')) f(field))
select * from d where metadata <> essence and not (metadata = '0' and field <> 'chroma')""")
def v4(proxy, clip):
    names = ("width", "height", "video_depth", "chroma")
    meta = proxy.select("clip_id", *[c(n).alias(f"meta_{n}") for n in names])
    real = clip.select("clip_id", *[c(n).alias(f"real_{n}") for n in names])
    return r.descriptor_mismatch(meta.join(real, "clip_id"), "clip_id")


@query("v6_lane_build", ["clip"], """
select clip_id, cast(i as int) as lane_index, cast((i * 3 + clip_id) % 8 as int) as source_channel, 'Mono' as kind, true as authoritative
from (select clip_id, unnest(range(0, lane_count)) as i from clip where lane_count > 0) l""")
def v6(clip):
    channels = F.transform(F.sequence(F.lit(0), c("lane_count") - 1), lambda i: ((i * 3 + c("clip_id")) % 8).cast("int"))
    return clip.where("lane_count > 0").select("clip_id", F.explode(r.lanes(channels)).alias("l")).select("clip_id", "l.*")


@query("v10_message_limits", ["message_log"], """
select session_id, seq, payload_len > 200 as payload_over, length(opcode) > 8 as name_over from message_log""")
def v10(message_log):
    return message_log.select("session_id", "seq", (c("payload_len") > 200).alias("payload_over"),
                              (F.length("opcode") > 8).alias("name_over"))


@query("j17_manifest_check", ["documents"], """
, m as (select doc_id as item_id, sha256(text) as digest from documents where doc_id % 13 <> 4),
e as (select doc_id as item_id, case when doc_id % 17 = 3 then sha256(concat(text, '!')) else sha256(text) end as expected
  from documents where doc_id % 19 <> 5)
select coalesce(m.item_id, e.item_id) as item_id, case when m.item_id is null then 'missing' when e.item_id is null then 'unexpected'
  when digest = expected then 'ok' else 'changed' end as status from m full outer join e on m.item_id = e.item_id""")
def j17(documents):
    docs = documents.select(c("doc_id").alias("item_id"), c("text").alias("content"))
    # Planted: some media are absent, some are not in the manifest, some have another digest there.
    listed = F.when(c("item_id") % 17 == 3, F.concat("content", F.lit("!"))).otherwise(c("content"))
    manifest = docs.where("item_id % 19 <> 5").select("item_id", F.sha2(listed, 256).alias("expected"))
    return md.manifest_check(docs.where("item_id % 13 <> 4"), manifest)
