"""Ordered scans that do not put a whole key into one task.

``row_number``, running sums, ``lag`` and "last known value" over ``partitionBy(key)`` send every row
of a key to one task, so a clip or session holding a third of all rows stalls the job. Here a key is
cut into chunks by value, each chunk is scanned on its own, one summary row per chunk is scanned
across chunks, and the result is carried back into the chunk's rows:

    rows  --window(key, chunk)-->  local positions  --join(key, chunk)-->  final values
    rows  --group(key, chunk)-->   one summary row  --window(key)------->  carry-in

``chunk`` must not decrease along the order. It is computed from the row's own values, never from the
physical partition, so a recomputed task gives the same chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 1 << 16


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division, exact for BIGINT and DECIMAL."""
    a = F.col(a) if isinstance(a, str) else a
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    rank: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add position-dependent columns along ``order`` within ``keys``.

    rank   1-based position
    sums   running sum up to and including the row
    lags   value of the previous row
    lasts  last non-null value up to and including the row
    befores  last non-null value strictly before the row
    maxes  running maximum up to and including the row

    Keys must not be null; ``order`` is ascending.
    """
    sums, lags, lasts, befores, maxes = (dict(m or {}) for m in (sums, lags, lasts, befores, maxes))
    known = lasts | befores
    keep = df.columns
    values = {f"_v_{n}": c for m in (sums, lags, known, maxes) for n, c in m.items()}
    rows = df.withColumns({"_chunk": chunk, **values})
    place = F.struct(*order)

    # One row per (key, chunk), reduced map-side before its shuffle.
    summary = [F.count(F.lit(1)).alias("_n")]
    summary += [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    summary += [F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), place).alias(f"_t_{n}") for n in lags]
    summary += [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in known
    ]
    summary += [F.max(f"_v_{n}").alias(f"_m_{n}") for n in maxes]
    heads = rows.groupBy(*keys, "_chunk").agg(*summary)

    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c_n")] if rank else []
    carried += [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carried += [F.lag(f"_t_{n}").over(across).alias(f"_c_{n}") for n in lags]
    carried += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in known]
    carried += [F.max(f"_m_{n}").over(before).alias(f"_c_{n}") for n in maxes]
    carry = heads.select(*keys, "_chunk", *carried)

    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    if rank or lags:
        local["_rn"] = F.row_number().over(within)
    local |= {f"_w_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}
    local |= {f"_w_{n}": F.lag(f"_v_{n}").over(within) for n in lags}
    local |= {f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in lasts}
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    local |= {f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(ahead) for n in befores}
    local |= {f"_w_{n}": F.max(f"_v_{n}").over(upto) for n in maxes}

    # Windows first: their sort by (keys, chunk, order) also serves the join on (keys, chunk).
    both = rows.withColumns(local).join(carry, [*keys, "_chunk"], "left")
    out = [F.col(c) for c in keep]
    if rank:
        out.append((F.col("_rn") + F.col("_c_n")).cast("bigint").alias(rank))
    out += [(F.col(f"_w_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    out += [
        F.when(F.col("_rn") == 1, F.col(f"_c_{n}")["v"]).otherwise(F.col(f"_w_{n}")).alias(n) for n in lags
    ]
    out += [F.coalesce(f"_w_{n}", f"_c_{n}").alias(n) for n in known]
    out += [F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in maxes]
    return both.select(*out)
