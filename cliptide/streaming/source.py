"""Command and decision logs as file streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for streams, leaving the settings of the caller's as they are.

    State lives in RocksDB, off the heap. Every state partition is opened in every micro-batch and their
    number is fixed for a stream's life, so there are at most two per core.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(name, spark.conf.get(name))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", str(min(wanted, 2 * spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


# Rows of a landed file, at most: a micro-batch must not grow with the log, as one session may hold all of it.
ROWS_PER_FILE = 1_000_000


def land(waves: Sequence[DataFrame], path: str, order: Sequence[str], files: int = 1) -> str:
    """Write a log to be read as a stream: waves one after another, each in ``order``, nulls last.

    A wave is one ordered write: ranges of ``order`` become files of ROWS_PER_FILE rows at most, ``files`` of them or more. A
    tie-breaker in ``order`` cuts a burst of one instant too. Waves and files get times that rise in this order, by which a
    file stream takes them, so a store must keep the times that it is given.
    """
    for k, wave in enumerate(waves):
        rows = wave.count()
        n = max(files, -(-rows // ROWS_PER_FILE))
        by = [F.col(c).asc_nulls_last() for c in order]
        wave.repartitionByRange(n, *by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/{k:06d}")
    _set_times(waves[0].sparkSession, path, len(waves))
    return path


def _set_times(spark: SparkSession, path: str, waves: int) -> None:
    """Give the files of a landed log rising times in the order of their names, a millisecond apart."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(f.getPath().toString()) for k in range(waves) for f in store.listStatus(hadoop.Path(root, f"{k:06d}"))]
    shown = sorted(n for n in names if not n.rsplit("/", 1)[1].startswith(("_", ".")))
    begin = store.getFileStatus(root).getModificationTime() - len(shown)
    for i, name in enumerate(shown):
        store.setTimes(hadoop.Path(name), begin + i, -1)


def open_stream(spark: SparkSession, path: str, schema, ts: str, files_per_trigger: int = 1) -> DataFrame:
    """Read a landed log as a stream with its declared schema, a fixed number of files a trigger; event time becomes
    TIMESTAMP here only, because a watermark does not take the zone-less type."""
    log = stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}/*")
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a parquet table in the shared folder and read it back with ``spark``."""
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(spark: SparkSession, stream: DataFrame, label: str, each: Callable[[DataFrame, int], None]) -> int:
    """Drain a stream through ``each``; returns the number of the last batch, -1 if there was none."""
    state = fresh_path(spark, f"{label}-state")
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress.batchId if q.lastProgress else -1
