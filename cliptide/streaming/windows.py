"""Watermarked streams: duplicates, late rows and live counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def drop_repeated(stream: DataFrame, keys: list[str], ts: str, bound: str) -> DataFrame:
    """First arrival of each key within the bound."""
    return stream.withWatermark(ts, bound).dropDuplicatesWithinWatermark(keys)


def live_counters(stream: DataFrame, ts: str, every: str, lateness: str, counters: dict[str, Column]) -> DataFrame:
    """Counters per tumbling interval, emitted once the watermark has passed it."""
    per = stream.withWatermark(ts, lateness).groupBy(F.window(ts, every).alias("w")).agg(
        *[F.sum(e.cast("bigint")).alias(n) for n, e in counters.items()])
    return per.select(F.col("w.start").alias("start"), *counters)


class WindowCounter(StatefulProcessor):
    """Counts one window of event time; rows that come after the watermark has passed its end go out one by one."""

    def __init__(self, counters: list[str], columns: list[str]):
        self.counters, self.columns = counters, columns
        self.state_type = T.StructType([T.StructField(n, T.LongType()) for n in counters])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.counts = handle, handle.getValueState("counts", self.state_type)

    def _out(self, kind: str, start, n: int, **values) -> pd.DataFrame:
        frame = pd.DataFrame({"kind": [kind] * n, "start_ms": pd.array([start] * n, "Int64")})
        for name in (*self.counters, *self.columns):
            frame[name] = values.get(name, pd.array([None] * n, "Int64" if name in self.counters else object))
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end = key[0], key[1]
        late = None if pd.isna(start) else "late" if end <= timerValues.getCurrentWatermarkInMs() else None
        if late or pd.isna(start):
            for frame in rows:
                yield self._out(late or "untimed", None if pd.isna(start) else int(start), len(frame), **{c: frame[c] for c in self.columns})
            return
        counts = list(self.counts.get()) if self.counts.exists() else [0] * len(self.counters)
        for frame in rows:
            counts = [n + int(frame[f"n_{c}"].sum()) for n, c in zip(counts, self.counters)]
        self.counts.update(tuple(counts))
        self.handle.registerTimer(int(end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            values = {c: pd.array([n], "Int64") for c, n in zip(self.counters, self.counts.get())}
            self.counts.clear()
            yield self._out("window", int(key[0]), 1, **values)

    def close(self) -> None:
        pass


def accounted_counters(
    stream: DataFrame, ts: str, seconds: int, lateness: str, counters: dict[str, Column], keep: list[str], parts: int = 8
) -> DataFrame:
    """Counters per tumbling window, and every row that no window took, from one reading of the stream.

    Rows have a kind: ``window`` with its counters, once the watermark has passed it (one a window and part: add them up);
    ``late`` for a row whose window was over when it came, ``untimed`` for one without event time, with the columns
    ``keep``. A window is spread over ``parts`` by a hash of these columns. Rows whose counters are all null, as a
    heartbeat's, only move the watermark.
    """
    ms, width = F.unix_millis(ts), seconds * 1000
    start = ms - F.pmod(ms, F.lit(width))
    flags = {f"n_{n}": e.cast("bigint") for n, e in counters.items()}
    known = F.coalesce(*[F.col(n) for n in flags])
    marked = stream.withWatermark(ts, lateness).withColumns({**flags, "start_ms": start, "end_ms": start + width})
    # The first condition names the event time, so that no row is left out below the watermark.
    marked = marked.where(known.isNotNull() | F.col(ts).isNull()).where(known.isNotNull())
    keyed = marked.select("start_ms", "end_ms", F.pmod(F.xxhash64(*keep), F.lit(parts)).alias("part"), *[F.coalesce(n, F.lit(0)).alias(n) for n in flags], *keep)
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_ms", T.LongType()),
                        *[T.StructField(n, T.LongType()) for n in counters], *[stream.schema[c] for c in keep]])
    return keyed.groupBy("start_ms", "end_ms", "part").transformWithStateInPandas(
        WindowCounter(list(counters), keep), outputStructType=out, outputMode="Append", timeMode="EventTime")
