"""What once met in one group: quotas, allocation, the bootstrap and rankings, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from biblioloom.config import DEFAULT
from biblioloom.operators import evaluation, ingest, ranking
from biblioloom.operators.lineage import ranked_within


def test_quota_matches_the_walk(spark):
    r = random.Random(6)
    sessions = {s: [(p, r.choice([0, 1, 2, 3, r.randrange(40)])) for p in range(r.randint(1, 40))] for s in range(12)}
    sessions[99] = [(p, 7) for p in range(500)]  # one session with most of the rows
    table = spark.createDataFrame([(s, p, n) for s, own in sessions.items() for p, n in own], "session_id long, paper_id long, n long").repartition(5)
    for budget in (0, 1, 37, 200, 100_000):
        got = {(x["session_id"], x["paper_id"]): x["taken"] for x in ingest.quota(table, budget).collect()}
        assert got == {(s, p): t for s, own in sessions.items() for p, t in ingest.equal_quota(own, budget)}
    assert ingest.quota(table.limit(0), 5).count() == 0


def test_allocation_walks_on_until_the_places_are_full(spark, monkeypatch):
    """The rows that the cap lets in lie hundreds of places down, in several sessions at once."""
    monkeypatch.setattr(ranking, "BLOCK", 2)
    r, rows, want = random.Random(2), [], {}
    for s in range(4):
        pool = []
        for i in range(260):
            hot = i < 60 * s
            sources = [1] if hot else r.sample(range(2, 9), r.randint(0, 3))
            pool.append({"paper_id": i, "score": 500.0 - i // 3, "age_years": 0.5 if r.random() < 0.05 else 4.0, "direction": r.choice(["FORWARD", "BACKWARD"]), "sources": sources if sources or i % 2 else None})
        r.shuffle(pool)
        want[s] = [p["paper_id"] for p in ranking.choose(pool, 12, DEFAULT)]
        rows += [(s, p["paper_id"], p["score"], p["age_years"], p["direction"], p["sources"]) for p in pool]
    table = spark.createDataFrame(rows, "session_id long, paper_id long, score double, age_years double, direction string, sources array<long>")
    got = {}
    for x in ranking.allocate(table, 12, DEFAULT).orderBy("session_id", "position").collect():
        got.setdefault(x["session_id"], []).append(x["paper_id"])
    assert got == want
    assert ranking.allocate(table, 0, DEFAULT).count() == 0 and ranking.allocate(table.limit(0), 5, DEFAULT).count() == 0


def test_bootstrap_draws_as_python_does(spark):
    r = random.Random(8)
    values = [r.random() for _ in range(57)]
    draw = random.Random(evaluation.SEED)
    means = sorted(sum(draw.choices(values, k=57)) / 57 for _ in range(evaluation.RESAMPLES))
    table = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 2.5)], "run string, case_id long, v double").repartition(3)
    got = {x["run"]: x for x in evaluation.bootstrap(table, "run", "v", "case_id").collect()}
    assert (got["a"]["low"], got["a"]["high"]) == (pytest.approx(means[25]), pytest.approx(means[975])) == tuple(map(pytest.approx, evaluation.interval(values)))
    assert got["a"]["mean"] == pytest.approx(sum(values) / 57) and tuple(got["b"])[1:] == (2.5, 2.5, 2.5)


def test_places_within_groups(spark):
    r = random.Random(1)
    rows = [(0 if i % 3 else i, i, r.randrange(9)) for i in range(300)]
    table = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    got = {(x["g"], x["i"]): x["at"] for x in ranked_within(table, "g", [F.desc("v"), F.asc("i")], "at").collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for at, (_, i, _) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1])), 1):
            want[g, i] = at
    assert got == want
