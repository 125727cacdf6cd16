"""Incremental harvest: answers that arrive as files, each read once, into a stored table of the latest metadata.

The stream's checkpoint knows which files were read; the stored table knows which batches are in, so a batch that is
delivered again after a crash changes nothing. The watermark (the latest update, from where the next harvest asks) and the
counts of records, pages and pages without any record are stored with the rows in one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioloom.operators.corpus import keep_last
from biblioloom.sources import metadata
from biblioloom.sources.stored import Versioned

COUNTS = ("pages", "empty_pages", "records")


def page_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Files of a folder, one answer each, as (page_id, value, arrived)."""
    rows = spark.readStream.options(wholetext=True, **options).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("page_id"), "value", F.col("_metadata.file_modification_time").alias("arrived"))


def absorb(store: Versioned, pages: DataFrame, batch_id: int | None = None) -> bool:
    """Folds answers (page_id, value, arrived) into the tables ``metadata`` and ``harvest`` of ``store``; for ``foreachBatch``.

    Of several records of an id the one that came last counts: a later batch, in a batch a later page (by arrival, then name), and in a page a later update.
    False where the batch was in already. Only the buckets that hold ids of the batch are read and written.
    """
    if not store.is_new(batch_id):
        return False
    found = metadata.harvest_pages(pages, keep=("page_id", "arrived"))[0]
    fresh = store.stage(found.withColumn("seq", F.struct("arrived", "page_id", "updated")), batch_id, "records")
    counts = pages.agg(F.count("*").alias("pages"))
    got = fresh.agg(F.count("*").alias("records"), F.max("updated").alias("watermark"), F.countDistinct("page_id").alias("_full"))
    now = counts.join(got).select("pages", (F.col("pages") - F.col("_full")).alias("empty_pages"), "records", "watermark")  # two single rows
    old = store.read("harvest")
    both = now if old is None else old.unionByName(now)
    total = both.agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("watermark").alias("watermark"))
    latest = keep_last(fresh.drop("page_id", "arrived"), "arxiv_id")
    fold = lambda rows: rows.groupBy("arxiv_id").agg(F.max_by(F.struct("primary_category", "categories", "updated"), "_new").alias("_r")).select("arxiv_id", "_r.*")
    return store.merge("metadata", latest, ["arxiv_id"], fold, batch_id, also={"harvest": total})


def harvest_into(pages: DataFrame, store: Versioned, checkpoint: str):
    """Starts the stream over all answers that are there now; it goes on from its checkpoint when started again."""
    writer = pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, batch_id: absorb(store, rows, batch_id) and None).start()


def next_request(store: Versioned, kind: str = "cs") -> dict[str, str]:
    """The parameters with which the next harvest goes on from the stored watermark."""
    rows = store.read("harvest")
    return metadata.harvest_params(rows.first()["watermark"] if rows is not None else None, kind)
