"""Work that once grew faster than its tables: results against plain Python, on rows that meet under one key."""

import contextlib
import math
import random
import threading

import numpy as np
import pytest

from biblioloom.operators import corpus, evaluation, lineage, vectors


@contextlib.contextmanager
def ends_within(spark, seconds):
    """Cancels all jobs after ``seconds``, so that work of another order fails instead of going on."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_title_matches_of_one_title(spark):
    """300,000 papers of one title: 90,000 million pairs, none of which has to be made."""
    papers = spark.range(300_000).selectExpr("id AS paper_id", "'On Graphs' AS title", "cast(if(id % 11 = 0, null, id % 10) AS int) AS year", "if(id % 7 = 3, null, concat('Ada X', id % 50)) AS author")
    with ends_within(spark, 60):
        rows = corpus.title_matches(papers.withColumnRenamed("paper_id", "probe_id"), papers).collect()
    assert len(rows) == 300_000 and all(x["paper_id"] <= x["probe_id"] for x in rows)


def test_title_matches_by_pairs(spark):
    """Years and surnames that are unknown on either side, unequal spellings of one title, and repeated probes."""
    r = random.Random(3)
    rows = [(i, r.choice(["On Graphs", "on graphs!", "Граф", "", None]), r.choice([None, 1, 2, 3, 0]), r.choice([None, "A B", "C b", "D", ""])) for i in range(150)]
    table = spark.createDataFrame(rows, "paper_id long, title string, year int, author string")
    probes = table.unionByName(table.where("paper_id < 20")).withColumnRenamed("paper_id", "probe_id")
    plain = lambda t: (t or "").lower().strip("!")
    surname = lambda a: a.split()[-1].lower() if a else ""
    want = {}
    for i, t, y, a in rows:
        fit = [j for j, u, z, b in rows if plain(t) and plain(t) == plain(u) and (y is None or z is None or y == z) and (a is None or b is None or surname(a or "") == surname(b or ""))]
        if fit:
            want[i] = min(fit)
    assert {x["probe_id"]: x["paper_id"] for x in corpus.title_matches(probes, table).collect()} == want


@pytest.mark.parametrize("wide", [100_000, 12])
def test_grid_metrics_of_small_and_wide_cases(spark, monkeypatch, wide):
    """Each weight configuration by sorting, also where cases are dealt to parts; ties, cases without candidates, truth twice."""
    monkeypatch.setattr(evaluation, "WIDE", wide)
    monkeypatch.setattr(evaluation, "PART", 5)
    monkeypatch.setattr(evaluation, "CELLS", 64)
    r, k = random.Random(8), 4
    grid = [{"a": i / 2, "b": j / 2} for i in range(3) for j in range(3)]
    sizes = [*range(0, 40, 3), 90, 170]
    rows = [(c, p, {"a": float(r.randrange(4)), "b": r.choice([0.5, 1.0, 2.0])} if p % 5 else {"b": 1.5}) for c, n in enumerate(sizes) for p in r.sample(range(200), n)]
    truth = [(c, p) for c in range(len(sizes)) for p in r.sample(range(200), 30 if c % 4 else 0)]
    table = spark.createDataFrame(rows, "case_id long, paper_id long, features map<string,double>").repartition(3)
    got = {x["run"]: x for x in evaluation.sweep_metrics(table, spark.createDataFrame(truth + truth[:50], "case_id long, paper_id long"), grid, k).collect()}
    true = {c: {p for d, p in truth if d == c} for c, _ in truth}
    assert sorted(got) == list(range(9))
    for i, w in enumerate(grid):
        sums = [0.0] * 4
        for c, own in true.items():
            placed = [p for _, p in sorted((-sum(w[n] * f.get(n, 0.0) for n in "ab"), p) for d, p, f in rows if d == c)]
            hits = [j for j, p in enumerate(placed) if p in own]
            dcg = sum(1 / math.log2(j + 2) for j in hits if j < k)
            best = sum(1 / math.log2(j + 2) for j in range(min(k, len(own))))
            found = sum(j < k for j in hits)
            sums = [s + x for s, x in zip(sums, (found / len(own), found > 0, 1 / (hits[0] + 1) if hits else 0, dcg / best), strict=True)]
        assert [got[i][m] for m in ("recall", "hit", "rr", "ndcg")] == pytest.approx([s / len(true) for s in sums])
        assert got[i]["cases"] == len(true)


def shuffled(spark):
    """Bytes that tasks have written for shuffles so far."""
    return sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(False).apply(0)])


def test_grid_metrics_shuffle_candidates_once(spark):
    """With a hundred times the configurations, as much goes through shuffles as candidates are, not a hundred times that."""
    cases = spark.range(40_000).selectExpr("id % 4000 AS case_id", "id AS paper_id", "map('a', double(id % 7)) AS features")
    wrote = []
    for n in (1, 100):
        before = shuffled(spark)
        evaluation.sweep_metrics(cases, cases.where("paper_id % 3 = 0"), [{"a": i / 10} for i in range(n)], 20).collect()
        wrote.append(shuffled(spark) - before)
    assert 0 < wrote[1] < 2 * wrote[0]


def test_duplicates_of_many_strangers(spark):
    """Keys that strangers share make hundreds of thousands of small groups; they are compared many at once."""
    r = np.random.default_rng(4)
    x = r.standard_normal((30_000, 12))
    near = x[::100] + 0.02 * r.standard_normal((300, 12))
    u = np.vstack([x, near])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(u.tolist())], "id long, vector array<double>").repartition(8)
    with ends_within(spark, 60):
        got = {(x["a"], x["b"]) for x in vectors.duplicates(table, 0.99).collect()}
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for i in range(0, len(u), 1000):
        a, b = np.nonzero(u[i : i + 1000] @ u.T > 0.99)
        want |= {(p, q) for p, q in zip((a + i).tolist(), b.tolist(), strict=True) if p < q}
    assert len(want) >= 250 and got == want


def test_evaluate_shares_draws_and_keeps_names(spark):
    """All metrics of a run go through one bootstrap, under any name; cases large enough to be ranked by parts give the same places."""
    r, rows = random.Random(9), []
    for run in ("a|b", "c"):
        rows += [(run, c, p, i + 1) for c in range(30) for i, p in enumerate(r.sample(range(40), 12))]
    truth = [(c, p) for c in range(30) for p in r.sample(range(40), 5)]
    table, true = spark.createDataFrame(rows, "run string, case_id long, paper_id long, rank int"), spark.createDataFrame(truth, "case_id long, paper_id long")
    got = {(x["run"], x["metric"]): x for x in evaluation.evaluate(table, true, 4).collect()}
    for run in ("a|b", "c"):
        found = [sum((run, c, p, i) in rows for i in range(1, 5) for d, p in truth if d == c) / 5 for c in range(30)]
        x = got[run, "recall"]
        assert (x["mean"], x["low"], x["high"]) == pytest.approx((sum(found) / 30, *evaluation.interval(found)))
    assert len(got) == 8
    ranks = [sorted(map(tuple, evaluation.baseline(table.where("run = 'c'"), "rank").collect())) for lineage.WHOLE in (100_000, 11)]
    lineage.WHOLE = 100_000
    assert ranks[0] == ranks[1] and len(ranks[0]) == 360


def shuffled(spark) -> int:
    """Bytes that stages have written for shuffles so far."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    empty = gateway.jvm.java.util.ArrayList()
    return sum(x.shuffleWriteBytes() for x in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(empty, False, False, gateway.new_array(gateway.jvm.double, 0), empty)))


def test_evaluate_shuffles_runs_once_and_values_packed(spark):
    """A known run is not computed again for its name, and the bootstrap's ten copies of a run's values are small."""
    n = 200_000
    ranked = spark.range(n).selectExpr("'c' AS run", "id % 20000 AS case_id", "id AS paper_id", "CAST(id DIV 20000 + 1 AS INT) AS rank")
    true = spark.range(0, n, 3).selectExpr("id % 20000 AS case_id", "id AS paper_id")
    before = shuffled(spark)
    known = evaluation.evaluate(ranked.repartition(4), true, 4, ["c"]).collect()
    wrote = shuffled(spark) - before
    found, known = (sorted(map(tuple, x)) for x in (evaluation.evaluate(ranked, true, 4).collect(), known))
    for x, y in zip(found, known, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])
    assert wrote < 9_000_000


def test_metrics_of_unknown_ids(spark):
    """A truth without an id counts as never found, and a ranked row without one takes its place."""
    ranked = spark.createDataFrame([(1, None, 1), (1, 5, 2), (2, 7, 1), (None, 5, 1)], "case_id long, paper_id long, rank int")
    true = spark.createDataFrame([(1, None), (1, 5), (2, None), (None, 5)], "case_id long, paper_id long")
    got = {x["case_id"]: (x["recall"], x["hit"], x["rr"]) for x in evaluation.metrics(ranked, true, 3).collect()}
    assert got == {1: (0.5, 1, 0.5), 2: (0.0, 0, 0.0), None: (0.0, 0, 0.0)}


def test_size_of_a_group_comes_with_its_ranks(spark, monkeypatch):
    table = spark.createDataFrame([(c, i, float(i % 4)) for c in range(4) for i in range(5 * c + 1)], "case_id long, paper_id long, v double")
    for whole in (100_000, 7):
        monkeypatch.setattr(lineage, "WHOLE", whole)
        rows = evaluation.baseline(table, "v", "n").collect()
        assert {(x["case_id"], x["n"]) for x in rows} == {(c, 5 * c + 1) for c in range(4)}
        assert all(sorted(x["rank"] for x in rows if x["case_id"] == c) == list(range(1, 5 * c + 2)) for c in range(4))
