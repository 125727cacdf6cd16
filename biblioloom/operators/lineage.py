"""Cutting lineage in the folder that all executors share, and numbering rows without one task for all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where a session names none and runs inside one process (tests) a temporary one is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="biblioloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage, and with it the optimizer's guess of its size.

    A checkpoint keeps that guess, a product over all joins before it: in a loop its digits double at every
    round until planning takes longer than the work. Adaptive execution sees the true sizes anyway.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    if not hasattr(kept, "_jdf"):
        return kept
    plain = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return DataFrame(plain, spark)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as Parquet in the shared folder, a fraction of a checkpoint's size, and what deletes it after its last use."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame, **counts) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that are taken while an action passes over its rows, without another pass.

    ``observation.get`` has them after the first action; a task that runs again counts once.
    """
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def numbered(rows: DataFrame, order: list, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``: sorted parts, numbered each, moved on by the sizes of
    the parts before. Only the counts of parts meet in one task. With ``total``, a column of numbers,
    ``<total>_before`` is its sum over all rows before."""
    value = F.lit(0) if total is None else F.coalesce(F.col(total), F.lit(0))
    rows = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"), F.sum(value).alias("_sum"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_lead"))  # one row for each part
    own = Window.partitionBy("_part").orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(own))
    if total is not None:
        placed = placed.withColumn("_run", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - value)
    placed = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_place") + F.col("_before"))
    if total is not None:
        placed = placed.withColumn(f"{total}_before", F.col("_run") + F.col("_lead")).drop("_run")
    return placed.drop("_part", "_place", "_before", "_lead")


#: Rows of a group that one task may sort.
WHOLE = 100_000


def ranked_within(rows: DataFrame, group: str, order: list, name: str, size: str | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` inside each ``group``, also where one group has most rows.

    With ``size``, a column of that name has the number of rows of the group. Groups of up to ``WHOLE`` rows are sorted after one shuffle. Rows of larger ones take their place from a global order.
    """
    rows = cut(rows)
    large = cut(rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select(group, F.lit(True).alias("_large")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    whole = {} if size is None else {size: F.count("*").over(Window.partitionBy(group))}
    if large.isEmpty():
        return rows.withColumns({name: place, **whole})
    # as many large groups as rows / WHOLE
    dealt = rows.alias("r").join(F.broadcast(large).alias("l"), F.col(f"r.{group}").eqNullSafe(F.col(f"l.{group}")), "left")
    small = dealt.where("_large is null").select("r.*").withColumns({name: place, **whole})
    placed = cut(numbered(dealt.where("_large").select("r.*"), [group, *order], name))
    starts = placed.groupBy(group).agg((F.min(name) - 1).alias("_start"), *[F.count("*").alias(c) for c in whole]).withColumnRenamed(group, "_group")
    started = placed.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_start"))
    return small.unionByName(started.select(*small.columns))


#: Keys that hold more than this share of the rows (at most 64 of them) are joined by broadcast.
HEAVY = 64


def join_hot(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (stored, ``total`` of them) with the columns of ``values`` (``key`` unique), where few keys may hold most rows.

    Such keys, of which there are at most ``HEAVY``, meet a broadcast of their values; the others are shuffled.
    """
    heavy = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > total // HEAVY).select(key)
    heavy = F.broadcast(heavy)  # fewer than HEAVY + 1 rows
    few = rows.join(heavy, key, "left_anti").join(values, key)
    return few.unionByName(rows.join(F.broadcast(values.join(heavy, key, "left_semi")), key))
