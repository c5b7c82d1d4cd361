"""Intermediate tables of the operators, the bound on Arrow batches, and the tables' reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.work import freed, shared_dir, work_path, written

__all__ = ["BATCH_BYTES", "bounded_batches", "freed", "shared_dir", "table", "work_path", "written"]

#: Bytes of an Arrow batch; a longer row forms a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches that Python workers get to ``BATCH_BYTES``, unless the session's limit is lower: a batch of long texts must fit beside the work on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_now = spark.conf.get(name).rstrip("b")
    if bytes_now.isdigit() and int(bytes_now) > BATCH_BYTES:  # with another unit it was set by the user
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
