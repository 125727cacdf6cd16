"""The event log as a stream: replay kept as state for each session and paper, and label writes by batch.

``replay_stream`` and ``activity_stream`` are plain aggregations. ``ReplayState`` keeps the deciding event of each
(session, paper) as keyed state of ``transformWithStateInPandas``: rows may come late and in any order, the id decides, and a
row that comes twice changes nothing. It emits a row whenever a paper's state changes; ``upsert`` folds these
changes into the stored nodes.

``LabelWriter`` applies batches of label requests to a stored session: the event, the new state and the sweep that a
lost like asks for land in one versioned write, and a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from biblioloom.config import Policy
from biblioloom.operators import events as log
from biblioloom.operators import graph
from biblioloom.operators.events import KEY, LEAVE, STATE_OF
from biblioloom.sources.stored import Versioned

CHANGES = "session_id long, paper_id long, id long, state string"


def replay_stream(events: DataFrame) -> DataFrame:
    """Latest state of each session and paper; use the output modes update or complete."""
    known = events.where(F.col("event_type").isin(*STATE_OF, *LEAVE))
    state = F.create_map(*[F.lit(x) for pair in STATE_OF.items() for x in pair])
    last = known.groupBy(*KEY).agg(F.max_by("event_type", "id").alias("event_type"), F.max("id").alias("id"))
    return last.select(*KEY, "id", F.try_element_at(state, F.col("event_type")).alias("state"))


def activity_stream(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


class ReplayState(StatefulProcessor):
    """The deciding event (id, type) of a session's paper; emits (session_id, paper_id, id, state) when it changes, state null where the paper left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "id long, event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        best = held
        for pdf in rows:
            top = pdf.loc[pdf["id"].idxmax()]
            if best is None or top["id"] > best[0]:
                best = (int(top["id"]), str(top["event_type"]))
        if best is not None and best != held:
            self.last.update(best)
            yield pd.DataFrame({"session_id": [key[0]], "paper_id": [key[1]], "id": [best[0]], "state": [STATE_OF.get(best[1])]})

    def close(self) -> None:
        pass


def state_changes(events: DataFrame) -> DataFrame:
    """Changes of state from a stream of events, by keyed state (needs the RocksDB state store)."""
    known = events.where(F.col("event_type").isin(*STATE_OF, *LEAVE) & F.col("id").isNotNull() & F.col("session_id").isNotNull() & F.col("paper_id").isNotNull())
    keyed = known.select(*[F.col(c).cast("long") for c in KEY], F.col("id").cast("long"), "event_type").groupBy(*KEY)
    return keyed.transformWithStateInPandas(statefulProcessor=ReplayState(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def upsert(nodes: Versioned, changes: DataFrame, batch_id: int) -> None:
    """Folds changes into the stored (session_id, paper_id, id, state), the greatest id of a paper deciding; for ``foreachBatch``.

    A paper that left stays as a row without state, so that an older change that comes later cannot bring it back.
    """

    def merged(old: DataFrame | None) -> DataFrame:
        rows = changes.select(*KEY, "id", "state")
        both = rows if old is None else old.unionByName(rows)
        return both.groupBy(*KEY).agg(F.max("id").alias("id"), F.max_by("state", "id").alias("state"))

    nodes.replace("nodes", merged, batch_id)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay_into(events: DataFrame, nodes: Versioned, checkpoint: str):
    """Starts the stream from ``events`` to the stored nodes over all that is there now; it goes on from its checkpoint when started again.

    A stream keeps the settings that hold when it starts, so the session's own state store is set back at once.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        writer = state_changes(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return writer.foreachBatch(lambda rows, batch_id: upsert(nodes, rows, batch_id)).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


class LabelWriter:
    """Label requests (session_id, paper_id, to_state) against stored ``nodes``, ``log`` and ``edges``.

    Tables of ``store``: ``nodes`` (session_id, paper_id, state, depth), ``log`` (id, session_id, paper_id, event_type, actor, depth).
    """

    def __init__(self, store: Versioned, edges: DataFrame, policy: Policy):
        self.store, self.edges, self.policy = store, edges, policy

    def _sweep(self, nodes: DataFrame, events: DataFrame, sessions: list[int]) -> DataFrame:
        """(session_id, paper_id, depth) of the candidates that the sweeps of ``sessions`` take."""
        held, out = log.user_held(events), []
        for s in sessions:  # those whose like was lost in this batch
            own = nodes.where(F.col("session_id") == s)
            gone = graph.sweep(own, self.edges, held.where(F.col("session_id") == s), self.policy.max_depth)
            out.append(own.join(gone, "paper_id", "left_semi").select(*KEY, "depth"))
        made = out[0]
        for other in out[1:]:
            made = made.unionByName(other)
        return made

    def write(self, requests: DataFrame, batch_id: int) -> bool:
        """Applies one batch; False where it was applied before. For ``foreachBatch``.

        Of several requests for one paper in a batch the last by ``seq`` counts (the column may be absent: then the greatest state name).
        """
        if not self.store.is_new(batch_id):
            return False
        nodes, events = self.store.read("nodes"), self.store.read("log")
        seq = F.col("seq") if "seq" in requests.columns else F.col("to_state")
        asked = requests.groupBy(*KEY).agg(F.max_by("to_state", seq).alias("to_state"))
        done = self.store.stage(log.apply_labels(nodes, asked).where("changes"), batch_id, "done")
        new = nodes.join(done.select(*KEY, F.col("to_state").alias("_to")), [*KEY], "left")
        new = new.select(*KEY, F.coalesce("_to", "state").alias("state"), "depth")
        fresh = done.select(*KEY, F.col("event").alias("event_type"), F.lit("USER").alias("actor"), F.lit(None).cast("int").alias("depth"), F.struct(F.lit(0).alias("step"), *KEY).alias("seq"))
        after = self.store.stage(log.append(events, fresh), batch_id, "after")
        sessions = [r[0] for r in done.where("sweep").select("session_id").distinct().collect()]
        if sessions:
            new = self.store.stage(new, batch_id, "new")
            swept = self.store.stage(self._sweep(new, after, sessions), batch_id, "swept")
            removed = swept.select(*KEY, F.lit("GC_SWEPT").alias("event_type"), F.lit("SYSTEM").alias("actor"), "depth", F.struct(F.lit(1).alias("step"), *KEY).alias("seq"))
            after, new = log.append(after, removed), new.join(swept, [*KEY], "left_anti")
        self.store.commit({"nodes": new, "log": after}, batch_id)
        return True


def write_labels(requests: DataFrame, writer: LabelWriter, checkpoint: str):
    """Starts a stream of label requests into ``writer``."""
    stream = requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return stream.foreachBatch(lambda rows, batch_id: writer.write(rows, batch_id) and None).start()


def nodes_of(stored: DataFrame) -> DataFrame:
    """(session_id, paper_id, state) of stored changes, papers that left being gone."""
    return stored.where("state is not null").select(*KEY, "state")
