"""Replays as stateful streams: the batch machines, with small states of sessions in buckets and a bounded reorder buffer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import Machine
from . import source as src


def plain_column(column: pd.Series, whole: bool) -> list:
    """Values as the step functions take them.

    Integers reach pandas as floats where any row of the batch is null, if of another key.
    """
    missing = column.isna()
    if whole and column.dtype.kind != "i":
        column = column.fillna(0).astype(np.int64)
    return [None if m else v for v, m in zip(column.tolist(), missing)]


#: Rows of an output frame, about.
ROWS_PER_FRAME = 10_000
#: Keys that share a bucket of state, about, and least number of buckets.
KEYS_PER_BUCKET, LEAST_BUCKETS = 1024, 64
#: Rows of a batch for each key of the log, about: a batch may read and write the states of all keys.
ROWS_PER_KEY = 4
#: Rows of one key in a batch of several files, about: files are read side by side, so rows may wait for those before them.
ROWS_SIDE_BY_SIDE = 250_000


def sizes_for(log: DataFrame, key: str = "session_id") -> tuple[int, int]:
    """Buckets of state for a log like this one, and how many of its landed files make a batch.

    Buckets are fixed for a stream's life, as its state is kept by bucket. Batches grow with the number of keys, so that each
    row pays for a fixed number of states at most; a log of few keys, or one that a single key fills, goes a file at a time.
    """
    keys, rows, most = log.groupBy(key).count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
    wanted = -(-ROWS_PER_KEY * keys // src.ROWS_PER_FILE)
    bearable = ROWS_SIDE_BY_SIDE * rows // (most * src.ROWS_PER_FILE) if keys else 1
    return max(LEAST_BUCKETS, -(-keys // KEYS_PER_BUCKET)), max(1, min(wanted, bearable))


def buckets_for(log: DataFrame, key: str = "session_id") -> int:
    """Buckets of state for a log like this one; see ``sizes_for``."""
    return sizes_for(log, key)[0]


class MachineProcessor(StatefulProcessor):
    """Runs a machine per key, in order of the sequence number.

    Keys share buckets: a call into Python and into the state costs milliseconds, so it is made once a bucket and batch, not
    once a key, and the small states of a bucket travel as one list.

    A row that follows the last one replayed is stepped as it comes. A row ahead of a gap waits, in a list state, until the
    gap is closed or the watermark has passed the row: then what waits up to it is replayed without the missing rows. A
    row behind the last one replayed came too late and goes out marked, without touching the state. So what waits is
    bounded by the watermark's bound, and a batch of a key is never held as a whole.
    """

    def __init__(self, machine: Machine, key: T.StructField, seq: str, whole: set[str], first: int):
        self.machine, self.key, self.seq, self.whole, self.first = machine, key, seq, whole, first
        # Parsed here, on the driver: a worker has no session to parse with.
        self.of = T.StructField("_key", key.dataType)
        self.state_type = T.StructType([self.of, *machine.state_fields(), T.StructField("_last", T.LongType())])
        self.out_fields = machine.output_fields()
        self.names = [f.name for f in self.out_fields]
        self.at = machine.inputs.index(seq)

    def with_inputs(self, fields: Sequence[T.StructField]) -> MachineProcessor:
        self.row_type = T.StructType([self.of, *fields, T.StructField("event_ms", T.LongType())])
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("machine", self.state_type)
        self.waiting = handle.getListState("waiting", self.row_type)

    def _load(self) -> None:
        """States of the bucket's keys with the last number replayed, and the rows that wait, a heap for each key that has some."""
        self.states = {k: [self.machine.thaw(tuple(state)), last] for k, *state, last in self.kept.get()}
        self.heaps: dict = {}
        # The second number keeps rows of equal sequence number apart without comparing the rows.
        for i, (k, *row) in enumerate(self.waiting.get()):
            self.heaps.setdefault(k, []).append((row[self.at], i, tuple(row)))
        for heap in self.heaps.values():
            heapify(heap)
        self.number = sum(map(len, self.heaps.values()))
        self.waited = bool(self.heaps)

    def _save(self) -> None:
        self.kept.put([(k, *self.machine.freeze(state), last) for k, (state, last) in self.states.items()])
        held = [(k, *row) for k, heap in self.heaps.items() for *_, row in heap]
        if held:
            self.waiting.put(held)
            self.handle.registerTimer(max(0, min(row[-1] for row in held)) + 1)
        elif self.waited:
            self.waiting.clear()

    def _replay(self, key, of: list, heap: list, upto: int, out: list) -> None:
        """Step what waits while it follows on, or is not beyond ``upto``."""
        while heap and (heap[0][0] <= of[1] + 1 or heap[0][0] <= upto):
            seq, _, row = heappop(heap)
            if seq <= of[1]:
                out.append((key, True, *[seq if n == self.seq else None for n in self.names]))
                continue
            of[1] = seq
            of[0], produced = self.machine.step(of[0], row[:-1])
            out.extend((key, False, *p) for p in produced)

    def _release(self, watermark: int, out: list) -> None:
        """Replay of every key what waits up to the greatest sequence number whose time the watermark has passed."""
        for key, heap in list(self.heaps.items()):
            self._replay(key, self.states[key], heap, max((seq for seq, _, row in heap if row[-1] <= watermark), default=-1), out)
            if not heap:
                del self.heaps[key]

    def _frames(self, out: list) -> Iterator[pd.DataFrame]:
        """What is in ``out``, which is emptied."""
        for lo in range(0, len(out), ROWS_PER_FRAME):
            frame = pd.DataFrame(out[lo:lo + ROWS_PER_FRAME], columns=[self.key.name, "late", *self.names])
            for f in (self.key, *self.out_fields):
                if isinstance(f.dataType, T.IntegralType):
                    frame[f.name] = frame[f.name].astype("Int64")
                elif isinstance(f.dataType, T.BooleanType):
                    frame[f.name] = frame[f.name].astype("boolean")
            yield frame
        out.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._load()
        out: list = []
        self._release(watermark, out)
        states, heaps, at, step = self.states, self.heaps, self.at, self.machine.step
        for frame in rows:
            # A row without a time waits until the watermark moves on from here.
            times = [watermark + 1 if ms < 0 else ms for ms in frame["event_ms"].tolist()]
            keys = plain_column(frame[self.key.name], isinstance(self.key.dataType, T.IntegralType))
            for k, row in zip(keys, zip(*[plain_column(frame[n], n in self.whole) for n in self.machine.inputs], times)):
                of = states.get(k)
                if of is None:
                    of = states[k] = [self.machine.thaw(tuple(self.machine.initial)), self.first - 1]
                heap = heaps.get(k)
                if heap is None and row[at] == of[1] + 1:  # the usual case: the row's turn
                    of[1] = row[at]
                    of[0], produced = step(of[0], row[:-1])
                    out.extend((k, False, *p) for p in produced)
                    continue
                if heap is None:
                    heap = heaps[k] = []
                heappush(heap, (row[at], self.number, row))
                self.number += 1
                self._replay(k, of, heap, -1, out)
                if not heap:
                    del heaps[k]
            if len(out) >= ROWS_PER_FRAME:
                yield from self._frames(out)
        self._release(watermark, out)
        self._save()
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out: list = []
        self._release(timerValues.getCurrentWatermarkInMs(), out)
        if self.waited:
            self._save()
        yield from self._frames(out)

    def close(self) -> None:
        pass


def replay_stream(
    stream: DataFrame, machine: Machine, ts: str = "ts", bound: str = "1 hour", key: str = "session_id", seq: str = "seq", first: int = 1,
    buckets: int = 4 * LEAST_BUCKETS,
) -> DataFrame:
    """A machine over a stream keyed by session; needs the RocksDB state of ``stream_session``.

    State is kept in ``buckets`` by a hash of the key, see ``sizes_for``; a batch reads and writes the buckets that it meets.
    ``first`` is the sequence number that a session begins with, ``bound`` how late a row may be. Rows without a sequence
    number only move the watermark. A row without a time waits, ahead of a gap, until the watermark moves on.
    """
    keyed = T.StructType([stream.schema[key], T.StructField("late", T.BooleanType()),
                          *machine.output_fields()])
    columns = list(dict.fromkeys([key, *machine.inputs]))
    whole = {n for n in machine.inputs if isinstance(stream.schema[n].dataType, T.IntegralType)}
    # The condition names the event time, so it is not moved below the watermark. The time itself goes on as a number, so
    # that late rows reach the processor.
    timed = stream.withWatermark(ts, bound).where(F.col(seq).isNotNull() | F.col(ts).isNull()).where(F.col(seq).isNotNull())
    timed = timed.select(*columns, F.coalesce(F.unix_millis(ts), F.lit(-1)).alias("event_ms"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"))
    processor = MachineProcessor(machine, stream.schema[key], seq, whole, first).with_inputs([stream.schema[n] for n in machine.inputs])
    return timed.groupBy("_bucket").transformWithStateInPandas(processor, outputStructType=keyed, outputMode="Append", timeMode="EventTime")
