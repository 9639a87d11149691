"""Registered queries: a Spark callable with, where SQL can state it, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources import load, stage, view
from ..sources.adapters import VIEWS as SPARK_VIEWS
from .oracle_views import NEEDS, VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def with_views(body: str, views: Sequence[str], recursive: bool = False) -> str:
    """Prefix ``body`` with the views it reads; ``body`` may go on with its own ``, name as (...)``."""
    names: list[str] = []
    for v in views:
        for n in (*NEEDS.get(v, ()), v):
            if n in VIEWS and n not in names:
                names.append(n)
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    body = body.strip()
    joint = "" if body.startswith(",") else "\n"
    word = "with recursive" if recursive else "with"
    if not ctes:
        return f"{word} {body[1:].lstrip()}" if body.startswith(",") else body
    return f"{word} {ctes}{joint}{body}"


def query(
    name: str, views: Sequence[str] = (), sql: str | None = None, recursive: bool = False, settle: Sequence[str] = ()
):
    """Register ``fn`` under ``name``; it receives the named views or driver tables in order.

    Views in ``settle`` are written to the shared folder first: an ordered scan reads its input twice,
    and a view that is itself an ordered scan would be sorted and shuffled for each reading.
    """

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            inputs = [(view if v in SPARK_VIEWS else load)(spark, sf_dir, v) for v in views]
            return fn(*(stage(df, v) if v in settle else df for v, df in zip(views, inputs)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, views, recursive)
        return fn

    return register
