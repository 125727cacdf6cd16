"""Operators 11 and 12 against plain Python, with the odd inputs that each must bear."""

import hashlib
import math
import random

import numpy as np
import pytest

from biblioloom.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def made(r, n, size=32, first=0):
    return [(first + i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(size)], r.choice([None, 0, 1, 2])) for i in range(n)]


def fits(v, parts):
    return v is not None and len(v) > 0 and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)


# 11 -----------------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if fits(v, parts)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min((far(x, b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        found = [[best(p, x)[1] for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = []
    for i, v, label in kept:
        found = [best(p, x) for p, x in enumerate(cut(v))]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i if i is not None else -1, code, error, total[label], digest) for i, code, error, label in coded), digest


def codes_of(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("n", [5, 64, 200])
def test_vector_codes_match_brute_force(spark, n):
    rows = made(random.Random(n), n)
    odd = [
        (1000, None, 1), (1001, [], 1), (1002, [0.5] * 31 + [None], 1), (1003, [float("nan")] * 32, 1), (1004, [float("inf")] + [0.0] * 31, 2), (1005, [1e30] * 32, 0),
        (1006, [0.25] * 16, 0), (1007, [0.1] * 31, 0), (None, [0.125] * 32, None), (n - 1, [-0.001] * 32, 1), rows[0], rows[0],
    ]
    want, _ = brute_codes(rows + odd)
    assert codes_of(vector_codes.compress(vectors(spark, rows + odd).repartition(7))) == want


def test_vector_codes_of_a_hot_vector_and_odd_tables(spark):
    r = random.Random(3)
    rows = made(r, 40) + [(100 + i, [0.5] * 32, 1) for i in range(150)]
    table = vectors(spark, rows).selectExpr("*", "1 as code", "2 as error", "3 as _x", "'k' as label_error")
    assert codes_of(vector_codes.compress(table)) == brute_codes(rows)[0]
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 2), (2, [float("nan")], 1)])).count() == 0
    assert vector_codes.compress(vectors(spark, [])).columns == vector_codes.compress(vectors(spark, rows)).columns


def test_codebooks_need_no_order(spark):
    """The same books from any partitioning, also where the tree has three levels."""
    rows = vectors(spark, made(random.Random(8), 150))
    whole = vector_codes.whole_vectors(rows)
    want = vector_codes.fit(whole.coalesce(1), rounds=3)
    assert (vector_codes.fit(whole.repartition(9), rounds=3) == want).all()
    wide, vector_codes.WIDE = vector_codes.WIDE, 2
    try:
        assert (vector_codes.fit(whole.repartition(11), rounds=3) == want).all()
    finally:
        vector_codes.WIDE = wide


# 12 -----------------------------------------------------------------------------------------------


def brute_negatives(rows, every):
    kept = [(i, label, np.array([math.floor(256 * x) for x in v])) for i, v, label in rows if i is not None and label is not None and fits(v, 1) and all(abs(x) < 2**15 for x in v)]
    if not kept:
        return []
    size = len(min(kept, key=lambda r: (r[0], r[2].tolist()))[2])
    kept = [r for r in kept if len(r[2]) == size]
    out = []
    for i, label, v in [r for r in kept if r[0] % every == 0]:
        scored = sorted(((-int(v @ w), j, other) for j, other, w in kept), key=lambda x: x[:2])
        positives = [(j, -s) for s, j, other in scored if other == label and j != i][: hard_negatives.POSITIVES]
        for p, ps in positives:
            own = [(j, -s) for s, j, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps][: hard_negatives.NEGATIVES]
            out += [(i, p, rank, j, ps, s) for rank, (j, s) in enumerate(own, 1)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("ROWS", 8), ("ANCHORS", 4), ("GROUP", 8), ("SAMPLE", 600)):
        monkeypatch.setattr(hard_negatives, name, value)


def clustered(seed, n=500, size=12, kinds=6, spread=0.05):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(kinds)]
    return [(i, [float(np.float32(x + r.gauss(0, spread))) for x in r.choice(centres)], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.03, 0.8])
def test_hard_negatives_match_brute_force(spark, small_blocks, spread):
    rows = clustered(4, spread=spread)
    odd = [
        (600, None, 1), (601, [0.1] * 11 + [None], 1), (602, [float("inf")] * 12, 1), (610, [0.5] * 12, None), (None, [0.5] * 12, 1), (620, [1e6] * 12, 1), (630, [0.1] * 4, 1), (640, [0.0] * 12, 0),
        rows[10], rows[11], (650, [-0.3] * 12, 99), (-10, [0.9] * 12, 1),
    ]
    got = hard_negatives.mine(vectors(spark, rows + odd).repartition(5), every=10)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows + odd, 10)


def test_hard_negatives_of_equal_vectors_and_odd_tables(spark, small_blocks):
    rows = clustered(9, n=120) + [(200 + i, [0.5] * 12, i % 4) for i in range(120)]
    table = vectors(spark, rows).selectExpr("*", "1 as a", "2 as c", "3 as _x", "4 as score", "'b' as block")
    assert sorted(map(tuple, hard_negatives.mine(table, every=20).collect())) == brute_negatives(rows, 20)
    empty = hard_negatives.mine(vectors(spark, []))
    assert empty.count() == 0 and hard_negatives.mine(vectors(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 4, 2)])).count() == 0
    assert empty.dtypes == hard_negatives.mine(vectors(spark, rows), every=20).dtypes


def test_node_pairs_are_pruned_and_none_is_lost(spark, small_blocks):
    """With clusters most pairs of blocks go; every pair whose scores reach the bound stays."""
    from pyspark.sql import functions as F

    rows = clustered(5, n=800, kinds=8, spread=0.02)
    table = hard_negatives.whole_vectors(vectors(spark, rows), parts=1).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("_x", lambda v: F.floor(v * 256).cast("int")).alias("_x"))
    own = table.where("vec_id % 2 = 0")
    tree, top = hard_negatives.fit(table, 800, 8), hard_negatives.fit(own, 400, 8)
    assert tree.depth > hard_negatives.STEP
    candidates, anchors = hard_negatives.blocks(table, tree, top, 8, 800), hard_negatives.blocks(own, top, tree, 8, 400)
    assert candidates.agg(F.max("n"), F.sum("n")).first() == (8, 800)
    least = 600_000
    bounds = {"least": F.lit(float(least)), "most": F.lit(1e18)}
    above = hard_negatives.children(anchors, top, bounds, {k: F.first(k) for k in bounds})
    pairs = {tuple(r) for r in hard_negatives.descend(above, hard_negatives.children(candidates, tree, {}, {}), False).collect()}
    a, c = ({r["block"]: r for r in x.collect()} for x in (anchors, candidates))
    x = lambda r: np.frombuffer(r["x"], np.int32).reshape(r["n"], -1).astype(np.int64)
    mixed = lambda p, q: len({*p["labels"], *q["labels"]}) > 1
    needed = {(i, j) for i, p in a.items() for j, q in c.items() if mixed(p, q) and (x(p) @ x(q).T).max() >= least}
    assert needed and needed <= pairs and len(pairs) < len(a) * len(c) / 2
