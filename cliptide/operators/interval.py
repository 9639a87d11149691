"""As-of and interval joins without a per-key nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .scan import ROWS_PER_CHUNK, div, ordered_scan


def asof_backward(
    requests: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    at: str,
    request_id: str,
    point: str,
    chunk_width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Greatest ``point`` not after ``at`` per key; null when there is none.

    Positions of both sides become one ordered log and the last point is carried forward, so the work is
    one sort of both whatever the number of points per key. Only distinct positions enter it: requests
    for the same place share their answer, which is joined back to them.
    """
    kind = points.schema[point].dataType
    asked = requests.select(*keys, F.col(at).cast(kind).alias("_at"), F.lit(None).cast(kind).alias("_p"))
    known = points.select(*keys, F.col(point).alias("_at"), F.col(point).alias("_p"))
    places = asked.unionByName(known).groupBy(*keys, "_at").agg(F.max("_p").alias("_p"))
    answers = ordered_scan(places, keys, ["_at"], div("_at", chunk_width), lasts={point: F.col("_p")})
    return requests.withColumn("_at", F.col(at).cast(kind)).join(
        answers.select(*keys, "_at", point), [*keys, "_at"], "left").select(request_id, *keys, at, point)


def overlap_counts(
    requests: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    range_start: str,
    range_end: str,
    name: str,
    chunk_width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Requests with the number of ranges that ``[start, end)`` overlaps, without forming a pair.

    Of the ranges that begin before the request's end, those that end by its start do not count; both are running
    counts at a place. Only distinct places enter the scan, so equal requests and ranges share one.
    """
    place = lambda df, at, s, e: df.select(*keys, at.cast("bigint").alias("_at"), F.lit(s).cast("bigint").alias("_s"), F.lit(e).cast("bigint").alias("_e"))
    begun, by = F.col(end) - 1, F.col(start)
    marks = place(ranges, F.col(range_start), 1, 0).unionByName(place(ranges, F.col(range_end), 0, 1)).unionByName(
        place(requests, begun, 0, 0)).unionByName(place(requests, by, 0, 0))
    places = marks.where("_at is not null").groupBy(*keys, "_at").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    told = stage(ordered_scan(
        stage(places, "places"), keys, ["_at"], div("_at", chunk_width), sums={"_begun": F.col("_s"), "_ended": F.col("_e")}
    ).select(*keys, "_at", "_begun", "_ended"), "counts")
    first = told.select(*keys, F.col("_at").alias("_to"), F.col("_begun").alias("_b"))
    second = told.select(*keys, F.col("_at").alias("_from"), F.col("_ended").alias("_d"))
    asked = requests.withColumns({"_to": begun.cast("bigint"), "_from": by.cast("bigint")})
    met = asked.join(first, [*keys, "_to"], "left").join(second, [*keys, "_from"], "left")
    count = F.when(F.col(start) < F.col(end), F.coalesce(F.col("_b") - F.col("_d"), F.lit(0))).otherwise(0)
    return met.select(*requests.columns, count.cast("bigint").alias(name))


def covered_measure(
    requests: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    span: tuple[str, str],
    by: tuple[str, str],
    name: str,
    chunk_width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Requests with the length of ``span`` that the union of the spans ``by`` of their key covers.

    Spans may overlap and leave gaps. Ends of spans and of requests become places; a running count of open spans says
    whether the stretch up to the next place is covered, and a running sum of covered stretches is the measure up to a
    place. A request is the difference of two of these. No pair of request and span is formed, and equal places share one
    row, so frames that follow each other or repeat cost one place each. Empty spans cover nothing, empty requests get 0.
    """
    (s, e), (bs, be) = span, by
    place = lambda df, at, step: df.select(*keys, F.col(at).cast("bigint").alias("_at"), F.lit(step).cast("bigint").alias("_d"))
    some = spans.where(F.col(bs) < F.col(be))
    marks = place(some, bs, 1).unionByName(place(some, be, -1)).unionByName(place(requests, s, 0)).unionByName(place(requests, e, 0))
    places = stage(marks.where("_at is not null").groupBy(*keys, "_at").agg(F.sum("_d").alias("_d")), "places")
    chunk = div("_at", chunk_width)
    opened = ordered_scan(places, keys, ["_at"], chunk, sums={"_open": F.col("_d")}, lags={"_before": F.col("_at")})
    # Open just before this place: what is open from here on, less what changes here.
    gained = F.when((F.col("_open") - F.col("_d") > 0) & F.col("_before").isNotNull(), F.col("_at") - F.col("_before")).otherwise(0)
    told = stage(ordered_scan(
        stage(opened.select(*keys, "_at", gained.alias("_g")), "stretches"), keys, ["_at"], chunk, sums={"_m": F.col("_g")}
    ).select(*keys, "_at", "_m"), "measures")
    upto, since = (told.select(*keys, F.col("_at").alias(f"_{x}"), F.col("_m").alias(f"_m{x}")) for x in ("to", "from"))
    asked = requests.withColumns({"_to": F.col(e).cast("bigint"), "_from": F.col(s).cast("bigint")})
    met = asked.join(upto, [*keys, "_to"], "left").join(since, [*keys, "_from"], "left")
    covered = F.when(F.col(s) < F.col(e), F.coalesce(F.col("_mto") - F.col("_mfrom"), F.lit(0))).otherwise(0)
    return met.select(*requests.columns, covered.cast("bigint").alias(name))


def dyadic_cover(start: Column, end: Column) -> Column:
    """The blocks (level, block) of a binary tree over whole numbers that make up [start, end): two a level at most.

    Block b of level k is [b * 2^k, (b + 1) * 2^k). An empty range has none.
    """
    def at_level(k: Column) -> Column:
        floor = lambda x: F.call_function("shiftright", x.cast("bigint"), k)
        lo, hi = -floor(-start), floor(end)
        node = lambda odd, block: F.when((lo < hi) & (odd % 2 != 0), F.struct(k.alias("level"), block.cast("bigint").alias("block")))
        return F.array(node(lo, lo), node(hi, hi - 1))

    # A range that ends at a power of two may need the level of its own length, never one above it.
    levels = F.sequence(F.lit(0), F.length(F.bin(end - start)).cast("int"))
    nodes = F.filter(F.flatten(F.transform(levels, at_level)), lambda x: x.isNotNull())
    return F.when(start < end, nodes).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def _in_blocks(df: DataFrame, nodes: Column) -> DataFrame:
    return df.withColumn("_node", F.explode(nodes)).withColumns({"_level": F.col("_node.level"), "_block": F.col("_node.block")}).drop("_node")


def _above(df: DataFrame, at: str, levels: Sequence[int]) -> DataFrame:
    """Rows copied to the blocks above a whole number, on the levels in use only."""
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(at).cast("bigint"), k).alias("block")) for k in levels])
    return _in_blocks(df, nodes)


def _starts_inside(points: DataFrame, at: str, ranges: DataFrame, keys: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Pairs of a point and a range [start, end) around it: the range as dyadic blocks, the point in each level in use."""
    cut = _in_blocks(ranges, dyadic_cover(start, end))
    # Levels are at most as many as bits of a number, and known by one small aggregate.
    levels = sorted(cut.agg(F.collect_set("_level")).first()[0])
    if not levels:
        return points.join(ranges.limit(0), list(keys)).drop("_level", "_block")
    return _above(points, at, levels).join(cut, [*keys, "_level", "_block"]).drop("_level", "_block")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int,
) -> DataFrame:
    """Pairs whose half-open spans overlap, as an equi-join on dyadic blocks of ``width``.

    Of two spans that share a bucket of ``width``, one begins in a bucket of the other. A span of n buckets is 2 log n
    blocks of a binary tree, and a beginning lies in one block of each level, so rows grow by a logarithm however long a
    span is, and a long clip is spread over its blocks. Each pair is found once: from the right side's beginning if that is
    not before the left's, else from the left's. Empty spans overlap nothing. Column names of the two sides must differ
    except for the keys.
    """
    (ls, le), (rs, re_) = left_span, right_span
    floor = lambda x: div(x - F.pmod(x, F.lit(width)), width)
    bucket = lambda df, s, e, names: df.where(F.col(s) < F.col(e)).withColumns({names[0]: floor(F.col(s)), names[1]: floor(F.col(e) - 1) + 1})
    # Each side is read for its blocks, their levels and its beginnings.
    a, b = stage(bucket(left, ls, le, ("_ls", "_le")), "left-spans"), stage(bucket(right, rs, re_, ("_rs", "_re")), "right-spans")
    rights = _starts_inside(b, "_rs", a, keys, F.col("_ls"), F.col("_le"))
    lefts = _starts_inside(a, "_ls", b, keys, F.col("_rs") + 1, F.col("_re"))
    columns = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    return rights.select(columns).unionByName(lefts.select(columns)).where((F.col(re_) > F.col(ls)) & (F.col(rs) < F.col(le)))
