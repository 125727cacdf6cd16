"""Graph queries over all papers and edges, against plain Python."""

import os

import pytest

from biblioloom.plans import queries as library

SF = os.environ.get("TEST_WHOLE_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_whole_graph(spark):
    d = library.Data(spark, SF)
    papers = [r[0] for r in d.px_papers.select("paper_id").collect()]
    pairs = {(min(r), max(r)) for r in d.px_edges.select("citing_id", "cited_id").collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    comp = {}
    for p in sorted(papers):
        todo = [] if p in comp else [p]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = p
                todo += near.get(x, [])
    assert {r["paper_id"]: r["component"] for r in library.QUERIES["g07_components"](spark, SF).collect()} == comp
    s = library.QUERIES["g06_graph_stats"](spark, SF).first()
    assert (s["nodes"], s["edges"], s["components"]) == (len(papers), len(pairs), len(set(comp.values())))


def test_queries_without_sql_take_all_rows(spark):
    d = library.Data(spark, SF)
    assert library.QUERIES["g16_quota"](spark, SF).count() == d.px_edges.select("cited_id").distinct().count()
    assert library.QUERIES["e06_baseline_random"](spark, SF).select("paper_id").distinct().count() == d.px_papers.count()


def plain_rank(nodes, pairs, restart=None):
    """The power iteration of networkx: 0.85, 1e-6 for each node, at most 100 steps."""
    share = {i: 1 / len(restart or nodes) if not restart or i in restart else 0.0 for i in nodes}
    out, rank = {}, dict(share)
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for _ in range(100):
        old, lost = rank, sum(r for i, r in rank.items() if i not in out)
        rank = {i: (0.15 + 0.85 * lost) * share[i] for i in nodes}
        for a, bs in out.items():
            for b in bs:
                rank[b] += 0.85 * old[a] / len(bs)
        if sum(abs(rank[i] - old[i]) for i in nodes) < len(nodes) * 1e-6:
            return rank
    raise AssertionError("not converged")


@pytest.mark.parametrize("name", ["g02_pagerank", "g03_reverse_pagerank", "g04_undirected_pagerank", "x14_personal_pagerank"])
def test_pagerank_converges(spark, name):
    d = library.Data(spark, SF)
    nodes = {r[0] for r in d.px_papers.where("crawl_state <> 'STUB'").select("paper_id").collect()}
    pairs = {tuple(r) for r in d.px_edges.select("citing_id", "cited_id").collect() if r[0] in nodes and r[1] in nodes}
    back = {(b, a) for a, b in pairs}
    pairs = back if "reverse" in name else pairs | back if "undirected" in name else pairs
    anchors = {r[0] for r in d.px_anchors.collect()} & nodes if "personal" in name else None
    got = {r["paper_id"]: r["rank"] for r in library.QUERIES[name](spark, SF).collect()}
    assert got == pytest.approx(plain_rank(nodes, pairs, anchors), abs=2e-9)


def test_pagerank_says_when_it_does_not_converge(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "citing_id long, cited_id long")
    n = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    with pytest.raises(ArithmeticError):
        library.graph.pagerank(n, e, 2, tolerance=1e-9)
