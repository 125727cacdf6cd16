"""The audit table of expansion runs: requests, claims, progress, ends; each step gives the next table.

Columns: id, session_id, status, params, config_version, started_at, finished_at, error, and the counters.
Every change is scoped to the session, so an id of another session changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioloom.operators.lineage import numbered

# The counters of a run and the statuses that can still be stopped.
COUNTERS = ("n_pool", "n_filtered", "n_added", "api_calls", "cache_hits")
ACTIVE = ("QUEUED", "RUNNING")
RUN = "id long, session_id long, status string, params string, config_version string, started_at string, finished_at string, error string, " + ", ".join(f"{c} long" for c in COUNTERS)
INTERRUPTED = "interrupted: the engine stopped while this was running"


def _changed(runs: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return runs.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in runs.columns])


def enqueue(runs: DataFrame, asked: DataFrame, now: str | None = None) -> DataFrame:
    """The table with requests (session_id, params, config_version, seq); ids go on in the order of ``seq``.

    With ``now`` the runs start at once (the caller does the work itself), else they wait.
    """
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = numbered(asked, ["seq"], "_n").join(F.broadcast(last))  # one row
    kind = {f.name: f.dataType for f in runs.schema.fields}
    known = {
        "id": F.col("_last") + F.col("_n"), "session_id": F.col("session_id"), "params": F.col("params"), "config_version": F.col("config_version"),
        "status": F.lit("RUNNING" if now else "QUEUED"), "started_at": F.lit(now),
    }
    return runs.unionByName(new.select(*[known.get(c, F.lit(None)).cast(kind[c]).alias(c) for c in runs.columns]))


def active(runs: DataFrame) -> DataFrame:
    """The oldest unfinished run of each session."""
    return runs.where(F.col("status").isin(*ACTIVE)).groupBy("session_id").agg(F.min_by(F.struct(*runs.columns), "id").alias("_r")).select("_r.*")


def claim_next(runs: DataFrame, now: str) -> DataFrame:
    """The oldest waiting run becomes RUNNING."""
    first = runs.where("status = 'QUEUED'").agg(F.min("id").alias("_first"))
    marked = runs.join(F.broadcast(first))  # one row
    return _changed(marked, F.col("id") == F.col("_first"), {"status": F.lit("RUNNING"), "started_at": F.lit(now)}).drop("_first")


def _updated(runs: DataFrame, updates: DataFrame, values, extra: Column | None = None) -> DataFrame:
    own = [c for c in updates.columns if c not in ("id", "session_id")]
    told = updates.select("id", "session_id", F.lit(True).alias("_told"), *[F.col(c).alias(f"_{c}") for c in own])
    joined = runs.join(told, ["id", "session_id"], "left")
    where = F.coalesce(F.col("_told"), F.lit(False))
    return _changed(joined, where if extra is None else where & extra, values(own)).select(*runs.columns)


def record_progress(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Counters known so far (id, session_id, some counters); a null or missing one keeps what was there."""
    return _updated(runs, updates, lambda own: {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in own if c in COUNTERS})


def finish(runs: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """Ends (id, session_id, status, counters, error); a cancelled run stays cancelled but keeps its counters."""

    def values(own: list[str]) -> dict[str, Column]:
        kept = F.when(F.col("status") == "CANCELLED", F.col("status")).otherwise(F.col("_status"))
        return {"status": kept, "finished_at": F.lit(now), **{c: F.col(f"_{c}") for c in own if c in (*COUNTERS, "error")}}

    return _updated(runs, updates, values)


def cancel(runs: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The table after the cancellations (id, session_id), and the status each one met; null where nothing could be stopped."""
    met = asked.join(runs.select("id", "session_id", F.when(F.col("status").isin(*ACTIVE), F.col("status")).alias("previous")), ["id", "session_id"], "left")
    gone = _updated(runs, asked.select("id", "session_id").distinct(), lambda own: {"status": F.lit("CANCELLED"), "finished_at": F.lit(now)}, F.col("status").isin(*ACTIVE))
    return gone, met.select("id", "session_id", "previous")


def fail(runs: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """Unexpected ends (id, session_id, error)."""
    return _updated(runs, errors, lambda own: {"status": F.lit("FAILED"), "error": F.col("_error"), "finished_at": F.lit(now)})


def abandon_running(runs: DataFrame, now: str) -> DataFrame:
    """At a start every RUNNING run belongs to a process that is gone."""
    return _changed(runs, F.col("status") == "RUNNING", {"status": F.lit("FAILED"), "finished_at": F.lit(now), "error": F.coalesce("error", F.lit(INTERRUPTED))})


def latest(runs: DataFrame) -> DataFrame:
    """The most recent run of each session, whatever its status."""
    return runs.groupBy("session_id").agg(F.max_by(F.struct(*runs.columns), "id").alias("_r")).select("_r.*")


def stage_of(status: Column, filtered: Column, pooled: Column, added: Column) -> Column:
    """What a run is doing, from the counters that it has written; a run that is not RUNNING is at its status."""
    return (
        F.when(status != "RUNNING", status)
        .when(filtered.isNull(), "FETCHING")
        .when(pooled.isNull(), "POOLING")
        .when(added.isNull(), "RANKING")
        .otherwise("ADDING")
    )
