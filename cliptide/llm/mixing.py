"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in a shuffled order. A document's virtual finish time is the number of words of
its source up to and with it, divided by the source's target. One stream of all sources in order of finish time serves
each source in proportion to its target at any point, and the mix is the stream's head up to the budget. A source whose
target is above its size is queued several times over; a repeat starts where the pass before it ended.

- Sizes, sources and shuffle keys are read off the texts once; everything after that handles narrow rows.
- The running sums are ordered scans over chunks: a source is cut by its shuffle keys, so a source that holds a third of
  all documents is many chunks.
- The stream is cut into ranges of virtual time first. Ranges before the one in which the budget ends are taken whole,
  those behind it are left, and only the rows of that one range are put in order to find the last document taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ordered_scan
from ..sources import stage

WEIGHTS = (5, 2, 1)
#: Words taken over words there are, and passes over one source at most.
SHARE, PASSES = 1.5, 2
#: Rows that one window sorts.
ROWS_PER_CHUNK = 1 << 16
#: Hexadecimal digits of a shuffle key that place a document in a chunk of its source.
DIGITS = 8


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    bare = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(bare), F.lit(0)).cast("long")


def _queues(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Narrow rows: id, source, size, and the shuffle key, an MD5 of the id, or of the text where the id is null."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(
        doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")).alias("key"),
    )


def _sorted_scan(rows: DataFrame, order: list[str], **scans) -> DataFrame:
    """An ordered scan over all rows, whose ranges are scanned side by side.

    The range of a row is stored with it, so a lost task changes nothing.
    """
    ranged = rows.withColumn("one", F.lit(1)).repartitionByRange(*order).withColumn("chunk", F.spark_partition_id())
    return ordered_scan(stage(ranged, "ranges"), ["one"], order, F.col("chunk"), **scans)


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with ``no``, their place by code point from 0, null last."""
    ends = sources.withColumns({"last": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    return _sorted_scan(ends, ["last", "name"], rank="rank").select(*sources.columns, (F.col("rank") - 1).alias("no"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Adds ``target`` to sources (source, source_size, no): the budget by weight, none above ``passes`` times its size.

    What is above a source's limit is shared again by weight among the others until none is above. A round is one small
    aggregate, of which the driver sees the sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("long")
    rows = stage(sources.withColumns({"weight": weight, "most": passes * F.col("source_size")}), "weighed")
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = -1.0, -1
    while True:
        # A limit that is reached stays reached, because the level only rises as the excess is shared.
        reached = F.col("most") < F.col("weight") * F.lit(level)
        n, spent, rest = rows.agg(F.count_if(reached), F.sum(F.when(reached, F.col("most")).otherwise(0)), F.sum(F.when(reached, 0).otherwise(F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (budget - spent) / rest
    return rows.select(*sources.columns, F.least(F.col("weight") * F.lit(level), F.col("most").cast("double")).alias("target"))


def queue(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(doc_id, source, size, key, no, source_size, target, upto): ``upto`` is the running sum of its source in shuffled order."""
    rows = stage(_queues(docs, id_col, source_col, text_col), "queues")
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    told = stage(targets(sources, weights, share, passes), "targets").withColumnRenamed("source", "named")
    placed = rows.join(told, rows["source"].eqNullSafe(told["named"])).drop("named")
    # Shuffle keys are even, so a range of their first digits is an even part of the source.
    part = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("long")
    chunk = F.floor(part * F.ceil(F.col("n") / ROWS_PER_CHUNK) / (1 << 4 * DIGITS))
    scanned = ordered_scan(placed, ["no"], ["key", "doc_id", "size"], chunk, sums={"upto": F.col("size")})
    return stage(scanned.drop("n"), "queued")


def _place(nth: int) -> dict[str, Column]:
    """Where pass ``nth`` (from 0) of a document stands in the stream; finish time first, exact words of its source last."""
    words = F.col("upto") + nth * F.col("source_size")
    return {"finish": F.try_divide(words, F.col("target")), "no": F.col("no"), "words": words}


def last_taken(queued: DataFrame, share: float = SHARE, passes: int = PASSES) -> tuple | None:
    """Place (finish, no, words) of the last document within the budget; None if nothing is taken."""
    each = F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in _place(i).items()]) for i in range(passes)]))
    stream = queued.where("size > 0 and target > 0").select("size", each.alias("place")).select("size", "place.*")
    count, words = queued.agg(F.count("*"), F.sum("size")).first()
    budget = (words or 0) * share
    # Finish times of a source rise evenly, so equal ranges up to time 1 hold about as many rows each.
    ranges = max(1, count // ROWS_PER_CHUNK)
    ranged = stage(stream.withColumn("range", F.floor(F.col("finish") * ranges)), "stream")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("in_range")).withColumn("one", F.lit(1))
    upto = ordered_scan(sums, ["one"], ["range"], F.floor(F.col("range") / ROWS_PER_CHUNK), sums={"upto": F.col("in_range")})
    over, before = upto.where(F.col("upto") > F.lit(budget)).agg(F.min("range"), F.min("upto") - F.min_by("in_range", "range")).first()
    whole, edge = ranged, ranged.limit(0)
    if over is not None:
        whole = ranged.where(F.col("range") < over)
        edge = _sorted_scan(ranged.where(F.col("range") == over), ["finish", "no", "words"], sums={"sum": F.col("size")})
        edge = edge.where(F.col("sum") + before <= F.lit(budget))
    place = ["finish", "no", "words"]
    found = whole.select(place).union(edge.select(place)).agg(F.max(F.struct(place))).first()[0]
    return None if found is None else tuple(found)


def _within(place: dict[str, Column], last: tuple) -> Column:
    finish, no, words = (F.lit(x) for x in last)
    return (place["finish"] < finish) | ((place["finish"] == finish) & ((place["no"] < no) | ((place["no"] == no) & (place["words"] <= words))))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """What the mix takes of each document: (doc_id, source, size, source_size, target, passes, finish).

    One row a row of docs. ``passes`` is how often the document is taken, whole each time, ``finish`` its first virtual
    finish time (null for documents of no words, which are never taken). Each source's taken words differ from its target by
    less than a document, but for the words that documents behind the budget's end leave to others.

    Null texts have size 0; null is a source of its own, after all others. Rows of equal id are documents of their own.
    Empty tables give no rows. Of other columns nothing is read.
    """
    queued = queue(docs, weights, share, passes, id_col, source_col, text_col)
    last = last_taken(queued, share, passes)
    live = (F.col("size") > 0) & (F.col("target") > 0)
    times = F.lit(0)
    for i in range(passes) if last else ():
        times = times + F.when(live & _within(_place(i), last), 1).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", times.alias("passes"), F.when(live, _place(0)["finish"]).alias("finish"))


def mixed(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The stream itself: docs as often as taken, range-sorted by virtual finish time. Ids name one document here."""
    often = taken.where("passes > 0 and doc_id is not null").select(
        F.col("doc_id").alias("__id"), "finish", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("nth"), F.try_divide("source_size", "target").alias("round")
    ).withColumn("finish", F.col("finish") + (F.col("nth") - 1) * F.col("round"))
    return docs.join(often, docs["doc_id"] == often["__id"]).orderBy("finish", "doc_id").drop("__id", "round", "nth")


def digest(taken: DataFrame) -> DataFrame:
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


#: The same rows as DuckDB SQL.
SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), text, '')) as key
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as no from sized group by source
), weighed as (
  select *, [5, 2, 1][no % 3 + 1] as weight, 2 * source_size as most from sources
), budget as (
  select sum(source_size) * 1.5::double as words from sources
), ordered as (
  select *, row_number() over (order by most::double / weight, no) as k,
    coalesce(sum(most) over (order by most::double / weight, no rows between unbounded preceding and 1 preceding), 0) as spent,
    sum(weight) over (order by most::double / weight, no rows between current row and unbounded following) as rest
  from weighed
), level as (
  -- The first source in this order that is not above its limit when all before it are at theirs.
  select ((select words from budget) - spent) / rest as level from ordered
  where most::double / weight >= ((select words from budget) - spent) / rest order by k limit 1
), targets as (
  select *, least(weight * (select level from level), most::double) as target from weighed
), queued as (
  select s.*, no, source_size, target, sum(size) over (partition by no order by key, doc_id nulls first, size rows unbounded preceding) as upto
  from sized s join targets t on s.source is not distinct from t.source
), stream as (
  select size, no, upto + n * source_size as words, (upto + n * source_size)::double / target as finish
  from queued, (select unnest([0, 1]) as n) where size > 0 and target > 0
), last as (
  select finish, no, words from (select *, sum(size) over (order by finish, no, words) as total from stream)
  where total <= (select words from budget) order by finish desc, no desc, words desc limit 1
)
select doc_id, size, source_size, target,
  cast(coalesce(case when size > 0 and target > 0 then size * (
    case when (upto::double / target, no, upto) <= (select (finish, no, words) from last) then 1 else 0 end
    + case when ((upto + source_size)::double / target, no, upto + source_size) <= (select (finish, no, words) from last) then 1 else 0 end) end, 0) as bigint) as taken
from queued
"""
