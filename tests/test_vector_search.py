"""Vector search and duplicate review against full comparison."""

import random

import numpy as np
import pytest

from biblioloom.operators import vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(seed, n=300, size=16, kinds=12, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((kinds, size))
    return centres[r.integers(0, kinds, n)] + spread * r.standard_normal((n, size))


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, vector array<double>")


def brute(x, asked, k):
    c = unit(x) @ unit(x).T
    return {q: sorted(((-round(float(c[q, i]), 9), i) for i in range(len(x)) if i != q))[:k] for q in asked}


@pytest.mark.parametrize("spread", [0.25, 2.0])
def test_search_is_exact_and_its_first_step_recalls(spark, monkeypatch, spread):
    monkeypatch.setattr(vectors, "CHUNK", 40)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    x = clustered(1, spread=spread)
    rows, asked = table(spark, x), list(range(0, 300, 10))
    index = vectors.Index(rows)
    queries = rows.where("id % 10 = 0")
    got = {}
    for r in index.search(queries, 10).collect():
        got.setdefault(r["query"], []).append((r["rank"], -round(r["cosine"], 9), r["id"]))
    want = brute(x, asked, 10)
    assert {q: [(c, i) for _, c, i in sorted(own)] for q, own in got.items()} == want
    near = [(r["query"], r["id"]) for r in index.search(queries, 10, exact=False).collect()]
    hits = sum((-c, i) is not None and (q, i) in set(near) for q, own in want.items() for c, i in own)
    if spread < 1:
        assert hits >= 0.9 * 10 * len(asked)


def test_search_in_odd_tables(spark):
    x = [[1.0, 0.0], [0.0, 0.0], [2.0, 0.0], [0.0, 3.0], [1.0, 1.0]]
    rows = table(spark, x).unionByName(spark.createDataFrame([(7, None), (8, []), (9, [float("nan"), 1.0]), (10, [1.0, None]), (11, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])], "id long, vector array<double>"))
    found = sorted((r["query"], r["rank"], r["id"], round(r["cosine"], 6)) for r in vectors.Index(rows).search(rows, 2).collect())
    assert found == [(0, 1, 2, 1.0), (0, 2, 4, 0.707107), (2, 1, 0, 1.0), (2, 2, 4, 0.707107), (3, 1, 4, 0.707107), (3, 2, 0, 0.0), (4, 1, 0, 0.707107), (4, 2, 2, 0.707107)]
    empty = rows.limit(0)
    assert vectors.Index(empty).search(rows, 3).count() == 0 and vectors.Index(rows).search(empty, 3).count() == 0
    assert vectors.duplicates(empty).count() == 0 and vectors.classes(empty).count() == 0
    reached = spark.createDataFrame([(2,)], "paper_id long")
    assert {r["id"] for r in vectors.unreached(vectors.Index(rows).search(rows.where("id = 0"), 2), reached).collect()} == {4}


def test_duplicates_match_full_comparison(spark, monkeypatch):
    """Near copies at all distances around the threshold, a hot group of a few hundred, equal vectors as one class."""
    monkeypatch.setattr(vectors, "PART", 50)
    r = random.Random(2)
    x = clustered(5, n=120, spread=3.0)
    near = np.array([x[i % 60] + (0.02 + 0.2 * (i % 7)) * np.random.default_rng(i).standard_normal(16) for i in range(120)])
    hot = np.repeat(x[:1], 200, axis=0) + 0.01 * np.random.default_rng(7).standard_normal((200, 16))
    whole = np.vstack([x, near, hot, x[:30]])
    ids = list(range(len(whole)))
    r.shuffle(ids)
    rows = table(spark, whole, ids).repartition(6)
    same = {}
    for i, v in zip(ids, whole.tolist(), strict=True):
        same.setdefault(tuple(v), []).append(i)
    least = {i: min(own) for own in same.values() for i in own}
    assert {(x["id"], x["representative"]) for x in vectors.classes(rows).collect()} == set(least.items())
    reps = sorted(set(least.values()))
    u = unit(np.array([whole[ids.index(i)] for i in reps]))
    c = u @ u.T
    want = {(reps[i], reps[j]) for i in range(len(reps)) for j in range(i + 1, len(reps)) if c[i, j] > 0.97}
    got = {(x["a"], x["b"]) for x in vectors.duplicates(rows).collect()}
    assert len(want) > 15_000 and got == want


def test_review_tells_likeness_of_titles(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (1, 3, 0.98)], "a long, b long, cosine double")
    papers = spark.createDataFrame([(1, "Deep Learning"), (2, "Deep learning."), (3, "Shallow water waves")], "paper_id long, title string")
    got = {(x["a"], x["b"]): round(x["title_likeness"], 2) for x in vectors.review(pairs, papers).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] < 0.5 and vectors.review(pairs, papers, 0.9).count() == 1
