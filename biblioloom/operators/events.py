"""The append-only event log: latest events, replay to states, tombstones, transitions, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioloom.operators.lineage import numbered

# What an event makes of a node, and the moves that a label may make.
STATE_OF = {"SEED_ADDED": "SEED", "LIKED": "LIKED", "DISLIKED": "DISLIKED", "UNLABELED": "CANDIDATE", "RESTORED": "CANDIDATE"}
LEAVE = ("REMOVED", "GC_SWEPT", "CLEARED")
TOMBSTONE = ("REMOVED", "GC_SWEPT")
STATES = ("SEED", "CANDIDATE", "LIKED", "DISLIKED")
EVENT_FOR = {"CANDIDATE": "UNLABELED", "LIKED": "LIKED", "DISLIKED": "DISLIKED"}
KEY = ("session_id", "paper_id")


def append(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """The log with new events; ids go on from the last one in the order of ``seq``."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    placed = numbered(fresh, ["seq"], "_n").join(F.broadcast(last))  # one row
    return log.unionByName(placed.withColumn("id", F.col("_last") + F.col("_n")).drop("seq", "_n", "_last"))


def events_of(log: DataFrame, session_id: int, paper_id: int | None = None) -> DataFrame:
    """A session's events in the order of their ids, of one paper where it is given."""
    own = F.col("session_id") == session_id
    return log.where(own if paper_id is None else own & (F.col("paper_id") == paper_id)).orderBy("id")


def latest(events: DataFrame) -> DataFrame:
    """The event of highest id of each session and paper, by one partial aggregation."""
    rest = [c for c in events.columns if c not in (*KEY, "id")]
    top = events.groupBy(*KEY).agg(F.max(F.col("id")).alias("id"), F.max_by(F.struct(*rest), "id").alias("_e"))
    return top.select(*KEY, "id", "_e.*")


def tombstones(events: DataFrame) -> DataFrame:
    return latest(events).where(F.col("event_type").isin(*TOMBSTONE)).select(*KEY)


def user_held(events: DataFrame) -> DataFrame:
    """Papers whose latest event a user wrote, whatever their state."""
    return latest(events).where("actor = 'USER'").select(*KEY)


def replay(events: DataFrame) -> DataFrame:
    """(session_id, paper_id, state): the last meaningful event decides; leaving events drop the node."""
    known = events.where(F.col("event_type").isin(*STATE_OF, *LEAVE))
    state = F.create_map(*[F.lit(x) for pair in STATE_OF.items() for x in pair])
    last = known.groupBy(*KEY).agg(F.max_by("event_type", "id").alias("event_type"))
    return last.where(F.col("event_type").isin(*STATE_OF)).select(*KEY, F.try_element_at(state, F.col("event_type")).alias("state"))


def depth_at_removal(events: DataFrame) -> DataFrame:
    """The depth that the latest tombstone saved, else 1."""
    return events.groupBy(*KEY).agg(
        F.coalesce(F.max_by("depth", F.when(F.col("event_type").isin(*TOMBSTONE), F.col("id"))), F.lit(1)).alias("depth")
    )


def drift(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose stored state is not the replayed one; nodes without events are not touched."""
    now = replay(events).withColumnRenamed("state", "replayed")
    seen = events.select(*KEY).distinct()
    return (
        nodes.join(seen, [*KEY], "left_semi")
        .join(now, [*KEY], "left")
        .where(~F.col("state").eqNullSafe(F.col("replayed")))
        .select(*KEY, "state", "replayed")
    )


def transitions(spark: SparkSession) -> DataFrame:
    """The 4 x 4 table: what each wanted move does."""
    rows = []
    for a in STATES:
        for b in STATES:
            error = None
            if a != b:
                error = "SEED_NOT_LABELABLE" if a == "SEED" else "CANNOT_PROMOTE_TO_SEED" if b == "SEED" else None
            changes = a != b and error is None
            rows.append((a, b, changes, EVENT_FOR.get(b) if changes else None, changes and a == "LIKED", error))
    return spark.createDataFrame(rows, "from_state string, to_state string, changes boolean, event string, sweep boolean, error string")


def apply_labels(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each request (session_id, paper_id, to_state) with its outcome; unknown states are errors."""
    table = F.broadcast(transitions(nodes.sparkSession))  # 16 rows
    asked = wanted.join(nodes.select(*KEY, F.col("state").alias("from_state")), [*KEY], "left").join(table, ["from_state", "to_state"], "left")
    error = F.when(F.col("from_state").isNull(), "NOT_IN_GRAPH").when(F.col("changes").isNull(), "UNKNOWN_STATE").otherwise(F.col("error"))
    return asked.select(*KEY, "from_state", "to_state", F.coalesce("changes", F.lit(False)).alias("changes"), "event", F.coalesce("sweep", F.lit(False)).alias("sweep"), error.alias("error"))


def clear(nodes: DataFrame, session_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of a session, and the CLEARED events that say so."""
    gone = nodes.where(F.col("session_id") == session_id)
    events = gone.select(*KEY, F.lit("CLEARED").alias("event_type"), F.lit("USER").alias("actor"))
    return nodes.where(F.col("session_id") != session_id), events


def parse_states(raw: str | None) -> list[str] | None:
    """A comma list of states; None (no filter) where it names none, an error for an unknown one."""
    wanted = [w for w in (part.strip().upper() for part in (raw or "").split(",")) if w]
    if unknown := sorted(set(wanted) - set(STATES)):
        raise ValueError(f"unknown states {unknown}; known are {sorted(STATES)}")
    return wanted or None


def in_states(nodes: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Nodes in the wanted states: None is no filter, an empty list is no state at all."""
    return nodes if wanted is None else nodes.where(F.col("state").isin(*wanted) if wanted else F.lit(False))


def added_by(nodes: DataFrame, session_id: int, run: str) -> DataFrame:
    """Papers that a run of the session put into the graph."""
    return nodes.where((F.col("session_id") == session_id) & (F.col("added_by") == run)).select("paper_id")


def remove(nodes: DataFrame, log: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone`` (session_id, paper_id), and the log with a REMOVED event of each that was there;
    the event keeps the node's depth for a restoration."""
    there = nodes.join(gone.select(*KEY).distinct(), [*KEY], "left_semi")
    fresh = there.select(*KEY, F.lit("REMOVED").alias("event_type"), F.lit("USER").alias("actor"), "depth", F.struct(*KEY).alias("seq"))
    return nodes.join(gone, [*KEY], "left_anti"), append(log, fresh)


def restore(nodes: DataFrame, log: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with tombstoned papers of ``back`` (session_id, paper_id) again as CANDIDATE at their saved depth,
    the log with RESTORED events, and the requests that no tombstone stands for."""
    asked = back.select(*KEY).distinct()
    fit = asked.join(tombstones(log), [*KEY], "left_semi").join(depth_at_removal(log), [*KEY])
    made = fit.select(*KEY, F.lit("CANDIDATE").alias("state"), "depth")
    fresh = fit.select(*KEY, F.lit("RESTORED").alias("event_type"), F.lit("USER").alias("actor"), F.lit(None).cast("int").alias("depth"), F.struct(*KEY).alias("seq"))
    kept = nodes.select(*KEY, "state", "depth").join(made, [*KEY], "left_anti")
    return kept.unionByName(made), append(log, fresh), asked.join(tombstones(log), [*KEY], "left_anti")


def set_positions(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes with the coordinates (x, y) of ``places``; what has no new place keeps its own."""
    new = places.select(*KEY, F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias("_set"))
    moved = nodes.join(new, [*KEY], "left")
    pick = lambda c: F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return moved.select(*[pick(c) if c in ("x", "y") else F.col(c) for c in nodes.columns])
