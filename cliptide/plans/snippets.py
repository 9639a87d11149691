"""Inputs shared by several queries: the Spark form and the SQL form of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Audio index of every valid PCM packet.
INDEX = """, idx as (select *, start_sample + sample_count as end_sample from (
  select clip_id, channel, packet_no, row_number() over (partition by clip_id, channel order by packet_no) - 1 as edit_unit,
    cast(sum(payload_len // 3) over (partition by clip_id, channel order by packet_no) - payload_len // 3 as bigint)
      as start_sample, payload_len // 3 as sample_count, cast(file_offset as bigint) as file_offset, payload_len
  from packet where essence_key like 'pcm.%' and payload_len % 3 = 0) x)"""

# Seek and cue commands as frame requests and as sample-range requests on the clip of the same number.
REQUESTS = """, req as (select command_id as request_id, session_id as clip_id, frame, frame * 20 as req_start,
  frame * 20 + 10 * (frame % 7) as req_end from command_log where command in ('Seek', 'Cue'))"""

# The index with every 37th entry dropped and every 53rd repeated.
DAMAGED = INDEX + """, damaged as (select *, unnest(case when (edit_unit + 1) % 53 = 0 then [0, 1] else [0] end) as copy
  from idx where (edit_unit + 1) % 37 <> 0)"""


# The damaged index with every 29th entry reaching 15 samples into what follows it.
OVERLAPPING = DAMAGED + """, over_ as (select clip_id, channel, start_sample,
    end_sample + case when edit_unit % 29 = 0 then 15 else 0 end as end_sample from damaged)"""


def overlapping(index: DataFrame) -> DataFrame:
    return damaged(index).withColumn("end_sample", F.col("end_sample") + F.when(F.col("edit_unit") % 29 == 0, 15).otherwise(0))


def requests(command_log: DataFrame) -> DataFrame:
    return command_log.where("command in ('Seek', 'Cue')").selectExpr(
        "command_id as request_id", "session_id as clip_id", "frame", "frame * 20 as req_start",
        "frame * 20 + 10 * (frame % 7) as req_end")


def damaged(index: DataFrame) -> DataFrame:
    copies = F.when((F.col("edit_unit") + 1) % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return index.where((F.col("edit_unit") + 1) % 37 != 0).withColumn("copy", F.explode(copies))

# Does a row of prepared show a private path: every text it may show in, and its own flag.
PRIVATE = ("binding_ref", "proxy_binding_ref", "public_uri", "source_id", "workspace_uri", "original_media_id", "proxy_media_id")
EXPOSED = " or ".join(["private_path_exposed", *[f"coalesce(starts_with({f}, '/') or contains({f}, 'file:'), false)" for f in PRIVATE]])
