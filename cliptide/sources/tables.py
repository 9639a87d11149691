"""Typed parquet source and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Declared schemas: no inference pass over the files, and a type drift fails at the scan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read one table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for staged tables and stream state.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is only used
    where there is a single machine, that is under a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: The folder, below the shared one, of the innermost ``staging`` block.
_BLOCK: ContextVar[str] = ContextVar("staging block", default="")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_BLOCK.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Let what is staged inside the block go when the block ends, also by an error; gives the folder.

    A DataFrame made inside may read staged tables for as long as it is used, so results are read or written inside the
    block. Blocks may be nested: an inner one lets go of its own tables only. A block sees what its own thread stages, so
    blocks of several threads do not meet. A driver that is lost leaves a folder ``block-*``, which no running job of
    another block uses.
    """
    outer = _BLOCK.get()
    mine = f"{outer}block-{uuid.uuid4().hex}/"
    folder = f"{shared_dir(spark)}/{mine}".rstrip("/")
    token = _BLOCK.set(mine)
    try:
        yield folder
    finally:
        _BLOCK.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives executor loss, and keeps column pruning for every later reader, which
    matters where an operator reads its input more than once.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
