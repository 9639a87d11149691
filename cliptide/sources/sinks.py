"""Sinks: the public manifest and the per-session snapshot table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import exposes_any


def public_manifest(clips: DataFrame) -> DataFrame:
    """One public-safe record per clip; rows that show a private path in any text, or say so, are left out, not masked."""
    text = F.concat_ws("|", "public_uri", "width", "height", "duration_frames", "rate_num", "rate_den")
    return clips.where(~exposes_any()).select(
        "clip_id", "public_uri", "width", "height", "duration_frames", F.sha2(text, 256).alias("checksum"))


MANIFEST_SCHEMA = "clip_id bigint, public_uri string, width int, height int, duration_frames bigint, checksum string"


def write_manifest(clips: DataFrame, path: str) -> None:
    public_manifest(clips).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


#: Bytes of a row of numbers in a Parquet row group before encoding, about.
BYTES_PER_VALUE = 8


def store_clustered(df: DataFrame, path: str, by: Sequence[str], rows_per_group: int) -> DataFrame:
    """Write ``df`` range-partitioned and sorted by the columns ``by`` in row groups of about ``rows_per_group`` rows."""
    group_bytes = max(1024, rows_per_group * len(df.columns) * BYTES_PER_VALUE)
    (
        df.repartitionByRange(*by).sortWithinPartitions(*by).write
        .option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 8))
        .option("parquet.block.row.count.limit", rows_per_group).option("parquet.page.row.count.limit", max(1, rows_per_group // 8))
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotTable:
    """Newest row per key, kept by ``foreachBatch`` as a log-structured table.

    A batch writes its own newest rows as a run of level 0; every FAN_OUT runs of a level become one of the next. So what a
    batch writes follows the batch, each row is rewritten once a level, and the runs of a version are the digits of its
    number in base FAN_OUT. Names follow from the batch number alone: a batch that is run again after a failure overwrites
    its own runs with the same rows, readers of earlier versions are not touched, and nothing is kept in the driver.
    """

    FAN_OUT = 8

    def __init__(self, path: str, key: str, newest: str, schema: str):
        self.path, self.key, self.newest, self.schema = path, key, newest, schema

    def runs(self, version: int) -> list[str]:
        """Paths of the runs that make up a version, the oldest first."""
        out, done, level = [], version + 1, 0
        while done:
            done, digit = divmod(done, self.FAN_OUT)
            out += [self._run(level, done * self.FAN_OUT + i) for i in reversed(range(digit))]
            level += 1
        return out[::-1]

    def _run(self, level: int, number: int) -> str:
        return f"{self.path}/{level}-{number}"

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(self.newest)).alias("s")).select(self.key, "s.*")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        self._newest(batch).write.mode("overwrite").parquet(self._run(0, batch_id))
        level, number = 0, batch_id
        while number % self.FAN_OUT == self.FAN_OUT - 1:
            parts = [self._run(level, number - i) for i in range(self.FAN_OUT)]
            level, number = level + 1, number // self.FAN_OUT
            merged = batch.sparkSession.read.schema(self.schema).parquet(*parts)
            self._newest(merged).write.mode("overwrite").parquet(self._run(level, number))

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """A version's rows; before the first one there are none."""
        if version < 0:
            return spark.createDataFrame([], self.schema)
        return self._newest(spark.read.schema(self.schema).parquet(*self.runs(version)))
