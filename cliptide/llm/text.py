"""Helpers for whole texts inside Arrow tasks."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled at once by the array code; a longer text is a slice of its own.
SLICE_CHARS = 1_000_000


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so other columns can neither clash nor travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(sizes: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows into ranges of about ``limit`` units; every row is in one range, whole."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


#: What a Python worker keeps between the tasks of one operator; the tasks of others let go of it.
KEPT: dict = {}


def let_go() -> None:
    """Free what another operator's tasks have kept in this worker."""
    if KEPT:
        KEPT.clear()
        gc.collect()


#: Bytes of text from which a task makes its arrays at a time.
PORTION_BYTES = 3_000_000


def portions(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches by the bytes of a text column, so that a task's memory does not follow the batch size."""
    let_go()
    for batch in batches:
        for lo, hi in slices(np.diff(utf8(batch.column(column))[1]), limit):
            yield batch.slice(lo, hi - lo)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling hashes.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64 = BASE) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every run of bytes other than white space; runs never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[:-1][starts[:-1] < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = starts[1:][starts[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one pass of prefix sums over the whole buffer."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
    undo = powers(n, inverse())
    return mix((prefix[end] - prefix[begin]) * undo[begin] + (end - begin).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def shingle_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; the caller masks runs that cross rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * BASE + words[j : j + n]
    return mix(out)


def rows_out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the named columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
