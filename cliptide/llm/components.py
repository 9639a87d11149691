"""Connected components of an edge table, by large-star and small-star rounds.

Each round joins every edge to the least neighbour of one of its ends. The least neighbours are staged first, so both
sides of the join are plain shuffles and a vertex with very many edges is split by adaptive execution. Edges are staged
between rounds; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage


def _to_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (hi, lo) joined to the least neighbour of each vertex: of all neighbours, or of the smaller ones only."""
    if both_ways:
        view = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    else:
        view = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = stage(view.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    met = view.join(least, "u")
    if both_ways:
        new = met.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        new = met.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select("u", "m"))
    return stage(new.where("hi <> lo").distinct(), "edges")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex with an edge to another one; component is the least vertex reachable.

    Vertices are BIGINT; loops and rows with a null end are left out.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    told = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == told or mark[0] == 0:
            break
        told = mark
        now = _to_least(_to_least(now, True), False)
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.withColumn("component", F.col("node")))
