"""URL filters by a temporal list join, with DataFrame functions only.

A list is a log of dated changes: an entry is put on the list or taken off. Changes become validity intervals, and
every capture is held against the entries valid on the day of its fetch. Entries are host suffixes (``a.example.org``
covers its subdomains) or a host with the first path segment (``a.example.org/news``).

The as-of join sorts days, not captures: changes and captures are first reduced to one row an entry and day, so an
entry's rows are bounded by the calendar however many captures a host has, and the answer is joined back by entry and
day, which spreads a hot host over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stage


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """First path segment, as written; null if there is none."""
    seg = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return F.when(seg != "", seg)


def entries_for(url: Column) -> Column:
    """Every list entry that would cover a URL: host suffixes of two labels or more, and host with first segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.isNotNull(), F.array_compact(F.array_append(suffixes, F.concat(host, F.lit("/"), segment_of(url)))))


def validity(changes: DataFrame) -> DataFrame:
    """Intervals (entry, valid_from, valid_to) of a log (entry, day, seq, listed); valid_to is the first day off the list.

    Of several changes of an entry on one day the one with the greatest seq holds, listing before delisting at equal
    seq. Repeated listings do not begin an interval anew. Rows with a null entry, day or state are left out.
    """
    known = changes.where("entry is not null and day is not null and listed is not null")
    daily = known.groupBy("entry", "day").agg(F.max(F.struct("seq", "listed")).alias("last")).select("entry", "day", F.col("last.listed").alias("listed"))
    by_day = Window.partitionBy("entry").orderBy("day")
    turns = daily.withColumn("before", F.lag("listed").over(by_day)).where(F.col("listed") != F.coalesce("before", F.lit(False)))
    return turns.withColumn("valid_to", F.lead("day").over(by_day)).where("listed").select("entry", F.col("day").alias("valid_from"), "valid_to")


def active_at(asks: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join: (entry, day, valid_from, valid_to) of the distinct asks (entry, day) that an interval covers."""
    begins = intervals.select("entry", F.col("valid_from").alias("day"), F.struct("valid_from", "valid_to").alias("span"))
    points = asks.select("entry", "day").distinct().withColumn("span", F.lit(None).cast(begins.schema["span"].dataType))
    # An interval that begins on the day itself comes first.
    order = Window.partitionBy("entry").orderBy("day", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # Entries that are not on any list are dropped before the sort.
    listed = points.join(intervals.select("entry").distinct(), "entry", "left_semi")
    found = begins.withColumn("asked", F.lit(False)).unionByName(listed.withColumn("asked", F.lit(True)))
    found = found.withColumn("span", F.last("span", ignorenulls=True).over(order)).where("asked and span is not null")
    return found.where("span.valid_to is null or day < span.valid_to").select("entry", "day", "span.valid_from", "span.valid_to")


def screen(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Every capture (page_id, url, day) with what the list says of it on its day.

    Adds blocked, n_active (entries that cover it) and entry, valid_from, valid_to of the most specific one: the longest,
    then the greatest. A capture without host or day is not blocked. Repeated captures stay.
    """
    intervals = stage(validity(changes), "intervals")
    distinct = captures.select("page_id", "url", "day").distinct()
    keyed = distinct.select("page_id", "url", "day", F.explode(entries_for(F.col("url"))).alias("entry")).where("day is not null")
    active = stage(active_at(keyed, intervals), "active")
    hits = keyed.join(active, ["entry", "day"])
    best = hits.groupBy("page_id", "url", "day").agg(
        F.count("*").alias("n_active"), F.max(F.struct(F.length("entry").alias("size"), "entry", "valid_from", "valid_to")).alias("best")
    )
    hit = stage(best.select(F.col("page_id").alias("__p"), F.col("url").alias("__u"), F.col("day").alias("__d"), "n_active", "best"), "hits")
    same = captures["page_id"].eqNullSafe(hit["__p"]) & (captures["url"] == hit["__u"]) & (captures["day"] == hit["__d"])
    return captures.join(hit, same, "left").select(
        "page_id", "url", "day", F.col("best").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
        "best.entry", "best.valid_from", "best.valid_to",
    )


_HEX = "0123456789abcdef"


def derived_log(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and a list log made from pages, which carry no dates: days and changes follow the URL's MD5.

    Every page reports one change: of its host (digest digit 0-7), of the host's parent domain (8-b) or of its host with
    first segment (c-f), listing it if the second digit is below 10. Days lie within 730 days of 2023-01-01.
    """
    h = F.md5(F.col("url").cast("binary"))
    digit = lambda at: F.position(F.substring(h, at, 1), F.lit(_HEX)) - 1
    day = lambda at: F.date_add(F.lit("2023-01-01").cast("date"), (digit(at) * 256 + digit(at + 1) * 16 + digit(at + 2)) % 730)
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    parent = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 2, F.size(labels)), ".")).otherwise(host)
    entry = F.when(digit(1) < 8, host).when(digit(1) < 12, parent).otherwise(F.concat(host, F.lit("/"), segment_of(F.col("url"))))
    captures = pages.select("page_id", "url", day(6).alias("day"))
    changes = pages.select(entry.alias("entry"), day(3).alias("day"), F.col("page_id").alias("seq"), (digit(2) < 10).alias("listed"))
    return captures, changes


#: The same rows as DuckDB SQL.
SQL = r"""
with hashed as (
  select page_id, url, md5(url) h,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.+$', ''), '') host,
    nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') seg
  from pages
), digits as (
  select *, [strpos('0123456789abcdef', substr(h, i, 1)) - 1 for i in range(1, 9)] d, string_split(host, '.') labels from hashed
), captures as (
  select page_id, url, date '2023-01-01' + ((d[6] * 256 + d[7] * 16 + d[8]) % 730)::int as day, host, seg, labels from digits
), changes as (
  select case when d[1] < 8 then host
    when d[1] < 12 then case when len(labels) > 2 then array_to_string(labels[2:], '.') else host end
    else host || '/' || seg end as entry,
    date '2023-01-01' + ((d[3] * 256 + d[4] * 16 + d[5]) % 730)::int as day, page_id as seq, d[2] < 10 as listed
  from digits
), daily as (
  select entry, day, listed from changes where entry is not null and day is not null
  qualify row_number() over (partition by entry, day order by seq desc, listed desc) = 1
), turns as (
  select *, lag(listed) over (partition by entry order by day) as before from daily
), intervals as (
  select entry, day as valid_from, valid_to from (
    select *, lead(day) over (partition by entry order by day) as valid_to from turns where listed <> coalesce(before, false)
  ) where listed
), keyed as (
  select page_id, url, day, unnest(list_concat([array_to_string(labels[i:], '.') for i in range(1, greatest(len(labels), 2))],
    case when seg is null then [] else [host || '/' || seg] end)) as entry
  from (select distinct * from captures where host is not null)
), hits as (
  select k.page_id, k.url, k.day, i.* from keyed k join intervals i
    on k.entry = i.entry and k.day >= i.valid_from and (i.valid_to is null or k.day < i.valid_to)
), best as (
  select page_id, url, day, entry, valid_from, valid_to, count(*) over (partition by page_id, url, day) as n_active
  from hits qualify row_number() over (partition by page_id, url, day order by length(entry) desc, entry desc, valid_from desc) = 1
)
select c.page_id, c.url, c.day, b.entry is not null as blocked, coalesce(b.n_active, 0) as n_active, b.entry, b.valid_from, b.valid_to
from captures c left join best b on c.page_id is not distinct from b.page_id and c.url = b.url and c.day = b.day
"""
