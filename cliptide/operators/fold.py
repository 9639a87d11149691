"""Ordered state replay over keyed logs, in parallel within a key.

A replay is a fold: each row's outcome depends on the state its predecessors left. Folding a whole
session in one task would let one long session hold up the job, so a session is cut into blocks. One
pass summarises every block: its end for each state it may start from (see probes.py). The summaries,
one small row a block, are composed in order and give every block its start. Then all blocks are
folded at once.

Where a summary is not sure of a block's end, the block is run from that start, and what it ends in is
an exact part of its summary from then on. The summaries are composed again until every end is sure or
has been run, so the result is the sequential one for any log.

Within a task rows stream through in Arrow batches in order; nothing is held but the current state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import stage
from .probes import NoProbe

Row = tuple

# A step costs far more than its bytes suggest, so tasks are sized by rows. A fixed number also keeps
# adaptive execution from merging them by size.
ROWS_PER_TASK = 20_000


@dataclass(frozen=True)
class Machine:
    """Rules of a replay.

    ``step(state, row)`` returns the next state and the output rows; ``finish(state)`` gives the rows
    left at the end of a key. Rows are plain tuples in the order of the declared columns. So are states,
    unless ``thaw`` turns the stored tuple into something handier to work on and ``freeze`` turns it back.
    """

    state: str
    initial: Row
    inputs: tuple[str, ...]
    outputs: str
    step: Callable[[Any, Row], tuple[Any, Sequence[Row]]]
    finish: Callable[[Any], Sequence[Row]] | None = None
    thaw: Callable[[Row], Any] = tuple
    freeze: Callable[[Any], Row] = tuple
    #: Makes a summary of a block, see probes.py.
    probe: Callable[[], Any] = NoProbe

    def state_fields(self) -> list[T.StructField]:
        return T.StructType.fromDDL(self.state).fields

    def output_fields(self) -> list[T.StructField]:
        return T.StructType.fromDDL(self.outputs).fields

    def state_names(self) -> list[str]:
        return [f.name for f in self.state_fields()]


def _values(column: pa.Array) -> list:
    """An Arrow column as plain Python values; far faster than one conversion per value."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind):
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        return [None if i is None else words[i] for i in _values(coded.indices)]
    if not (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    filled = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
    known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [v if k else None for v, k in zip(filled, known)]


def _s(name: str) -> str:
    return f"_s_{name}"


def _run(
    rows: DataFrame, marks: DataFrame | None, keys: Sequence[str], order: Sequence[str], machine: Machine, tasks: int, ends: bool
) -> DataFrame:
    """Fold every (key, block). A mark is a row that comes before its block and carries its start state."""
    group = [*keys, "_block"]
    states = machine.state_names()
    wanted = list(dict.fromkeys([*group, *order, *machine.inputs]))
    log = rows.select(*wanted, F.lit(1).alias("_place"))
    if marks is not None:
        log = log.unionByName(
            marks.select(*group, F.lit(0).alias("_place"), "_final", *map(_s, states)), allowMissingColumns=True)
    ordered = log.repartition(tasks, *group).sortWithinPartitions(*group, "_place", *order)

    key_fields = [rows.schema[k] for k in group]
    out_fields = machine.state_fields() if ends else machine.output_fields()
    schema = T.StructType([*(key_fields if ends else key_fields[:-1]), *out_fields])
    arrow = to_arrow_schema(schema)
    width = len(group) if ends else len(keys)
    initial, step, finish, inputs = machine.initial, machine.step, machine.finish, machine.inputs
    thaw, freeze = machine.thaw, machine.freeze
    marked = marks is not None

    def to_batch(out: list[Row]) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, final = None, initial, True

        def close() -> Sequence[Row]:
            if key is None:
                return ()
            if ends:
                return ((*key, *freeze(state)),)
            return [(*key[:width], *o) for o in finish(state)] if finish and final else ()

        for batch in batches:
            read = lambda n: _values(batch.column(batch.schema.get_field_index(n)))
            groups = zip(*[read(k) for k in group])
            places = read("_place")
            starts = list(zip(*[read(_s(n)) for n in states])) if marked else None
            finals = read("_final") if marked else None
            values = zip(*[read(n) for n in inputs])
            out: list[Row] = []
            for i, (k, row) in enumerate(zip(groups, values)):
                if k != key:
                    out.extend(close())
                    key, state, final = k, thaw(initial), True
                if places[i] == 0:
                    state = thaw(starts[i])
                    final = finals[i]
                    continue
                state, produced = step(state, row)
                if not ends:
                    head = k[:width]
                    out.extend((*head, *p) for p in produced)
            if out:
                yield to_batch(out)
        left = list(close())
        if left:
            yield to_batch(left)

    return ordered.mapInArrow(fold, schema)


def ordered_fold(log: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, block: Column) -> DataFrame:
    """Outputs of ``machine`` over ``log`` in ``order`` within ``keys``, exact for any block cut.

    ``block`` must not decrease along the order and bounds the rows of a key one task folds at a time.
    """
    group = [*keys, "_block"]
    wanted = list(dict.fromkeys([*group, *order, *machine.inputs]))
    # Read to see the blocks, once per round and for the result, so it is written out rather than
    # computed for each.
    rows = stage(log.withColumn("_block", block).select(*wanted), "fold-log")
    blocks = rows.groupBy(*group).agg(F.count("*").alias("_rows"))
    per_key = blocks.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_rows").alias("_rows"))
    most, total = per_key.agg(F.max("_n"), F.sum("_rows")).first()
    tasks = min(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) // ROWS_PER_TASK + 1)
    if (most or 0) < 2:
        return _run(rows, None, keys, order, machine, tasks, ends=False)

    many = per_key.where("_n > 1").select(*keys)
    marks, _ = block_starts(rows.join(many, list(keys), "left_semi"), keys, order, machine, tasks)
    return _run(rows, marks, keys, order, machine, tasks, ends=False)


def _summaries(rows: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, tasks: int) -> DataFrame:
    """(keys, _block, _summary): the summary of every block as JSON."""
    group = [*keys, "_block"]
    ordered = rows.select(*dict.fromkeys([*group, *order, *machine.inputs])).repartition(tasks, *group).sortWithinPartitions(*group, *order)
    told = T.StructType([*[rows.schema[k] for k in group], T.StructField("_summary", T.StringType())])
    arrow = to_arrow_schema(told)
    inputs, probe = machine.inputs, machine.probe

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        row_of = lambda: pa.RecordBatch.from_pylist([{**dict(zip(group, key)), "_summary": json.dumps(now.result())}], schema=arrow)
        for batch in batches:
            read = lambda n: _values(batch.column(batch.schema.get_field_index(n)))
            for k, row in zip(zip(*[read(k) for k in group]), zip(*[read(n) for n in inputs])):
                if k != key:
                    if key is not None:
                        yield row_of()
                    key, now = k, probe()
                now.step(row)
        if key is not None:
            yield row_of()

    return ordered.mapInArrow(summarise, told)


def _compose(told: DataFrame, keys: Sequence[str], machine: Machine, tasks: int) -> DataFrame:
    """Start of every block as the blocks before it tell, and whether its own end is still open.

    Rows are (keys, _block, _summary, and for a block that has been run its start and end). Blocks of a key pass one after
    another, a small row each.
    """
    group, states = [*keys, "_block"], machine.state_names()
    fields = [*[told.schema[k] for k in group], *[T.StructField(_s(f.name), f.dataType) for f in machine.state_fields()]]
    schema = T.StructType([*fields, T.StructField("_open", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    initial, follow = machine.freeze(machine.thaw(machine.initial)), machine.probe().follow
    width = len(keys)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, initial
        for batch in batches:
            read = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            runs = zip(zip(*[read(k) for k in group]), read("_summary"), read("_known"), zip(*[read(f"_k{n}") for n in states]), zip(*[read(f"_e{n}") for n in states]))
            out = []
            for k, summary, known, begin, end in runs:
                if k[:width] != key:
                    key, state = k[:width], initial
                after, sure = (end, True) if known and begin == state else follow(json.loads(summary), state)
                out.append((*k, *state, not sure))
                state = tuple(after)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return told.repartition(tasks, *keys).sortWithinPartitions(*group).mapInArrow(compose, schema)


def block_starts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, tasks: int) -> tuple[DataFrame, int]:
    """Start state of every block, with a mark on the last of a key; and how often the summaries were composed."""
    group, states = [*keys, "_block"], machine.state_names()
    summaries = stage(_summaries(rows, keys, order, machine, tasks), "fold-summaries")
    last = summaries.groupBy(*keys).agg(F.max("_block").alias("_last"))
    nothing = [F.lit(None).cast(f.dataType).alias(f"{p}{f.name}") for p in ("_k", "_e") for f in machine.state_fields()]
    ran = summaries.select(*group, F.lit(True).alias("_known"), *nothing).limit(0)
    for number in count(1):
        starts = stage(_compose(summaries.join(ran, group, "left"), keys, machine, tasks), "fold-starts")
        unsure = starts.where("_open")
        if unsure.isEmpty():
            marks = starts.join(last, list(keys)).withColumn("_final", F.col("_block") == F.col("_last"))
            return marks.select(*group, "_final", *map(_s, states)), number
        marked = unsure.withColumn("_final", F.lit(False)).drop("_open")
        ends = _run(rows.join(unsure.select(*group), group, "left_semi"), marked, keys, order, machine, tasks, ends=True)
        begun = marked.select(*group, F.lit(True).alias("_known"), *[F.col(_s(n)).alias(f"_k{n}") for n in states])
        fresh = begun.join(ends.select(*group, *[F.col(n).alias(f"_e{n}") for n in states]), group)
        ran = stage(fresh.unionByName(ran.join(unsure.select(*group), group, "left_anti")), "fold-ends")
