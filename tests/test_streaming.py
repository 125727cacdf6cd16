"""Streams with restarts, repeated batches and crashes between write and switch."""

import random

import pytest

from biblioloom.config import PROXY
from biblioloom.operators import events
from biblioloom.sources.stored import Versioned
from biblioloom.streaming import replay

KIND = "id long, session_id long, paper_id long, event_type string, actor string, depth int"


def made_events(seed, n=300):
    r = random.Random(seed)
    kinds = [*events.STATE_OF, *events.LEAVE, "NOTE"]
    rows = [(i, r.randrange(2), r.randrange(25), r.choice(kinds), "USER", 0) for i in range(n)]
    r.shuffle(rows)  # ids come in any order, so many rows are late
    return rows


def test_replay_by_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    rows = made_events(1)
    folder, nodes = str(tmp_path / "in"), Versioned(spark, str(tmp_path / "nodes"))

    def arrive(some):
        spark.createDataFrame(some, KIND).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
        replay.replay_into(stream, nodes, str(tmp_path / "checkpoint")).awaitTermination()
        return {tuple(r) for r in replay.nodes_of(nodes.read("nodes")).select("session_id", "paper_id", "state").collect()}

    want = lambda n: {tuple(r) for r in events.replay(spark.createDataFrame(rows[:n], KIND)).select("session_id", "paper_id", "state").collect()}
    arrive(rows[:60])
    arrive(rows[60:120])
    assert run() == want(120)
    arrive(rows[120:] + rows[:30] + [(None, 1, 1, "LIKED", "USER", 0), (10_000, None, 1, "LIKED", "USER", 0)])
    assert run() == want(len(rows))
    batch = nodes.manifest()["batch"]
    changes = spark.createDataFrame([(0, 999, 99_999, "SEED")], replay.CHANGES)
    replay.upsert(nodes, changes, batch)  # a batch that is delivered again
    assert nodes.read("nodes").where("paper_id = 999").count() == 0
    replay.upsert(nodes, changes, batch + 1)
    assert nodes.read("nodes").where("paper_id = 999").count() == 1


@pytest.fixture
def session(spark, tmp_path):
    """1 is a seed, 2 liked, 3 hangs on 2, 4 hangs on 2 but a user restored it, 5 hangs on 1; session 9 is another one."""
    store = Versioned(spark, str(tmp_path / "session"))
    states = [(1, "SEED"), (2, "LIKED"), (3, "CANDIDATE"), (4, "CANDIDATE"), (5, "CANDIDATE")]
    nodes = [(s, p, x, d) for s in (7, 9) for d, (p, x) in enumerate(states)]
    rows = [(1, 7, 2, "LIKED", "USER", None), (2, 7, 4, "RESTORED", "USER", None), (3, 7, 3, "NOTE", "SYSTEM", None)]
    store.commit({"nodes": spark.createDataFrame(nodes, "session_id long, paper_id long, state string, depth int"), "log": spark.createDataFrame(rows, KIND)})
    edges = spark.createDataFrame([(2, 3), (2, 4), (1, 5)], "citing_id long, cited_id long")
    return store, replay.LabelWriter(store, edges, PROXY)


def whole(store):
    nodes = sorted(map(tuple, store.read("nodes").collect()))
    return nodes, sorted(map(tuple, store.read("log").select("id", "session_id", "paper_id", "event_type", "actor", "depth").collect()))


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id long, paper_id long, to_state string, seq long")


def test_a_lost_like_lands_with_its_event_and_sweep(spark, session):
    store, writer = session
    requests = asked(spark, (7, 2, "LIKED", 1), (7, 2, "CANDIDATE", 2), (7, 1, "LIKED", 1), (7, 99, "LIKED", 1), (7, 5, "DISLIKED", 1), (7, 3, "SEED", 1))
    assert writer.write(requests, 5)
    nodes, log = whole(store)
    assert [n[1:3] for n in nodes if n[0] == 7] == [(1, "SEED"), (2, "CANDIDATE"), (4, "CANDIDATE"), (5, "DISLIKED")]
    assert len([n for n in nodes if n[0] == 9]) == 5
    assert [(p, e, a, d) for i, s, p, e, a, d in log[3:]] == [(2, "UNLABELED", "USER", None), (5, "DISLIKED", "USER", None), (3, "GC_SWEPT", "SYSTEM", 2)]
    assert [x[0] for x in log] == [1, 2, 3, 4, 5, 6]
    assert not writer.write(requests, 5) and not writer.write(requests, 4) and whole(store) == (nodes, log)
    assert writer.write(asked(spark, (7, 2, "CANDIDATE", 1)), 6) and whole(store) == (nodes, log)  # nothing to change


def test_a_crash_before_the_switch_leaves_the_version_before(spark, session, monkeypatch):
    store, writer = session
    before, requests = whole(store), asked(spark, (7, 2, "DISLIKED", 1))
    real = Versioned._at

    def broken(self, name):
        if name.startswith("manifests/."):
            raise OSError("lost")
        return real(self, name)

    monkeypatch.setattr(Versioned, "_at", broken)
    with pytest.raises(OSError, match="lost"):
        writer.write(requests, 8)
    assert whole(store) == before
    monkeypatch.setattr(Versioned, "_at", real)
    assert writer.write(requests, 8) and whole(store) != before
    versions = store._versions()
    store.clean(keep=1)
    assert store._versions() == versions[-1:] and len(whole(store)[0]) == 9
    assert len(list(store._fs.listStatus(store._at("data")))) == 1


def test_label_stream(spark, session, tmp_path):
    store, writer = session
    folder = str(tmp_path / "requests")
    for k, rows in enumerate(([(7, 5, "LIKED", 1)], [(7, 5, "DISLIKED", 2), (9, 3, "LIKED", 1)])):
        asked(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("session_id long, paper_id long, to_state string, seq long").parquet(folder)
        replay.write_labels(stream, writer, str(tmp_path / "checkpoint")).awaitTermination()
        assert store.manifest()["batch"] == k
    states = {n[:2]: n[2] for n in whole(store)[0]}
    assert states[7, 5] == "DISLIKED" and states[9, 3] == "LIKED"
    assert [e for _, s, p, e, _, _ in whole(store)[1] if (s, p) == (7, 5)] == ["LIKED", "DISLIKED"]
