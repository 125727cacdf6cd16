"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioloom.operators.lineage import cut, shared_folder

__all__ = ["cut", "sample_ids", "shared_folder", "small_batches", "table"]

#: Rows and bytes of one Arrow batch sent to a Python worker; keeps a worker's memory flat
#: even where many texts are very long.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold (see BATCH_ROWS)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sample_ids(labels: DataFrame, key: str, columns: list, limit: int) -> list:
    """At most ``limit`` labelled rows, chosen by a hash of their key (the same on every run)."""
    chosen = (
        labels.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.min(c).alias(c) for c in columns])
        .orderBy(F.xxhash64(key), key)
        .limit(limit)
    )
    return chosen.collect()
