"""Shuffles of very many small numbers: rows travel as arrays, one block for each input batch and bucket.

A hash bucket is one group of ``applyInArrow``; the number of buckets grows with the input so that a bucket stays
small, and makers keep at most one row a key and document of each batch, so a hot key adds a row a batch at most. The
anchors of ``lpf.py`` are dealt by a part of their key, so a hot K-mer adds a row a batch and context there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import let_go

#: Input bytes behind one bucket, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 12_000_000, 96
#: Bits of a row filter that is broadcast: a fixed size, whatever the corpus.
FILTER_BITS = 1 << 25

BLOCK = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("n", pa.int64()), ("block", pa.binary())])
BLOCK_DDL = "bucket long, kind byte, n long, block binary"


def bucket_count(rows: DataFrame, text_col: str = "text") -> int:
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_BUCKETS, int(size // BUCKET_BYTES))


def pack(bucket: np.ndarray, columns: Sequence[np.ndarray], kind: int = 0) -> pa.RecordBatch:
    """One block for each bucket with rows."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    columns = [c[order] for c in columns]
    blocks = [b"".join([c[a:b].tobytes() for c in columns]) for a, b in zip(first.tolist(), ends)]
    n = [b - a for a, b in zip(first.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([kind] * len(n), pa.int8()), pa.array(n, pa.int64()), pa.array(blocks, pa.binary())], schema=BLOCK)


def unpack(table: pa.Table, kind: int, types: Sequence) -> list[np.ndarray]:
    """The rows of one kind in a group of blocks, a column each."""
    let_go()
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for k, n, block in zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("block")):
        if k == kind:
            raw, at = memoryview(block.as_buffer()), 0
            for part, t in zip(parts, types):
                part.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def exchange(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], reduce: Callable[[pa.Table], pa.Table], out: str) -> DataFrame:
    """``make`` gives blocks, ``reduce`` sees all blocks of one bucket."""
    return rows.mapInArrow(make, BLOCK_DDL).groupBy("bucket").applyInArrow(reduce, out)


def earlier(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row: does a row of equal key and smaller document exist.

    Rows are put in key order, like suffixes of equal head in a suffix array; the previous or the next row with a
    smaller document is an earlier match if its key is the same. Pointers jump over rows that are themselves no match.
    """
    order = np.lexsort((np.arange(len(key)), key))
    k, d = key[order], doc[order]
    found = np.zeros(len(k), bool)
    for step in (-1, 1):
        near = np.arange(len(k)) + step
        todo = np.arange(len(k))
        while len(todo):
            at = near[todo]
            inside = (at >= 0) & (at < len(k))
            todo, at = todo[inside], at[inside]
            same = k[at] == k[todo]
            todo, at = todo[same], at[same]
            smaller = d[at] < d[todo]
            found[todo[smaller]] = True
            todo, at = todo[~smaller], at[~smaller]
            near[todo] = near[at]
    out = np.empty(len(k), bool)
    out[order] = found
    return out


def id_filter(ids: DataFrame, id_col: str = "doc_id"):
    """A broadcast bit array of fixed size over hashed ids, and the expression that tests a row: False means absent.

    It only thins rows before a join; where it is full, every row passes and the join decides alone.
    """
    spark = ids.sparkSession
    place = F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS))
    words = (
        ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    )
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    got = words.toArrow()
    held[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(held), place


def thin(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose id may be in ``ids``, and those whose id is not or is null."""
    shared, place = id_filter(ids, id_col)

    def part(keep: bool):
        def run(batches):
            let_go()
            for batch in batches:
                p = batch.column(batch.num_columns - 1).to_numpy()
                bit = shared.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)
                known = batch.column(id_at).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(((bit == 1) & known) == keep))

        return rows.withColumn("__place", place).mapInArrow(run, rows.schema)

    id_at = rows.columns.index(id_col)
    return part(True), part(False)


def apart(found: DataFrame) -> DataFrame:
    """``found`` for a join with rows that ``thin`` has kept: met by a shuffle, however small it is.

    Broadcast, it would leave the filter of ``thin`` and what reads the join in one stage, with two Python workers a core;
    Spark keeps those as long as the executor works, and each holds what its largest task took.
    """
    return found.hint("merge")
