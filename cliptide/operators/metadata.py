"""Metadata graph checks and clip associations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import rates_equal


def resolve_tags(uses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Local tag to property through its dimension; the first mapping of a tag wins.

    The dimension is reduced to one row per tag with a map-side minimum, so a repeated tag neither
    multiplies rows nor gathers in one task. Spark broadcasts it when its measured size allows.
    """
    first = mapping.groupBy("local_tag").agg(F.min_by("property", "position").alias("property"))
    return uses.join(first, "local_tag", "left")


def dangling_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose target is absent."""
    return refs.join(nodes.select(F.col("uid").alias("to_uid")), "to_uid", "left_anti")


def with_known_target(refs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """References whose target exists and is of ``kind``."""
    return refs.join(nodes.where(F.col("kind") == kind).select(F.col("uid").alias("to_uid")), "to_uid", "left_semi")


def resolve_ordered_refs(packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ordered reference arrays to rows keeping their position; unknown targets have a null kind."""
    opened = packages.select("uid", F.posexplode("refs").alias("position", "to_uid"))
    known = nodes.where("uid is not null").groupBy(F.col("uid").alias("to_uid")).agg(F.min("kind").alias("target_kind"))
    return opened.join(known, "to_uid", "left")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("uid is not null").groupBy("uid").agg(F.count("*").alias("copies")).where("copies > 1")


def missing_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("uid is null").groupBy("kind").agg(F.count("*").alias("missing"))


def diagnostics(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """All findings in one long table (finding, subject, detail)."""
    text = lambda c: F.col(c).cast("string")
    lost = dangling_refs(refs, nodes).select(
        F.lit("dangling-reference").alias("finding"), F.col("from_uid").alias("subject"), F.col("to_uid").alias("detail"))
    twice = duplicate_ids(nodes).select(
        F.lit("duplicate-id").alias("finding"), F.col("uid").alias("subject"), text("copies").alias("detail"))
    without = missing_ids(nodes).select(
        F.lit("missing-id").alias("finding"), F.col("kind").alias("subject"), text("missing").alias("detail"))
    return lost.unionByName(twice).unionByName(without)


def associate(originals: DataFrame, proxies: DataFrame, strict: bool = False) -> DataFrame:
    """Originals with their proxies: same source, equal rate and equal duration."""
    o = originals.select("clip_id", F.col("rate_num").alias("on"), F.col("rate_den").alias("od"),
                         F.col("duration_frames").alias("of"))
    p = proxies.select("clip_id", F.col("rate_num").alias("pn"), F.col("rate_den").alias("pd"),
                       F.col("duration_frames").alias("pf"))
    same = rates_equal(F.col("on"), F.col("od"), F.col("pn"), F.col("pd"), strict) & (F.col("of") == F.col("pf"))
    status = (
        F.when(F.col("on").isNull(), "OriginalMissing").when(F.col("pn").isNull(), "NoProxy")
        .when(same, "TimingCompatible").otherwise("Mismatch")
    )
    return o.join(p, "clip_id", "full_outer").select("clip_id", status.alias("status"))


def manifest_check(media: DataFrame, manifest: DataFrame) -> DataFrame:
    """Media content against its manifest: ok, changed, unexpected or missing."""
    seen = media.select("item_id", F.sha2("content", 256).alias("digest"))
    both = seen.join(manifest, "item_id", "full_outer")
    status = (
        F.when(F.col("digest").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
        .when(F.col("digest") == F.col("expected"), "ok").otherwise("changed")
    )
    return both.select("item_id", status.alias("status"))
