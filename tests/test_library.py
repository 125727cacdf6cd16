"""Golden cases of the library's operators."""

import math

import pytest
from pyspark.sql import functions as F

from biblioloom.config import DEFAULT, Policy
from biblioloom.functions import dates, scores, text
from biblioloom.operators import corpus, evaluation, events, filters, graph, legacy, ranking
from biblioloom.sources import metadata
from biblioloom.streaming.replay import replay_stream


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "citing_id long, cited_id long")


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "paper_id long")


def as_map(df, k="paper_id", v=None):
    return {r[k]: r[v or df.columns[-1]] for r in df.collect()}


PAPER = "paper_id long, title string, year int, citation_count long, venue string, category string, crossed array<string>, fields array<string>, types array<string>"


@pytest.mark.parametrize(
    "paper,reason",
    [
        (("Image data", 2009, 9, None, None, None, None, ["Dataset"]), "PRE_ERA"),
        (("X", None, 9, None, "cs.LG", None, None, None), "YEAR_UNKNOWN"),
        (("X", 2020, 9, None, "cs.LG", None, None, ["Dataset"]), "IS_DATASET"),
        (("A survey of graphs", 2020, 500, None, "cs.LG", None, None, None), "CAT_PRIMARY_CORE"),
        (("A survey of graphs", 2020, 3, None, "cs.LG", None, None, None), "LOW_CITE_SURVEY"),
        (("Surveying land", 2020, 3, None, "cs.LG", None, None, None), "CAT_PRIMARY_CORE"),
        (("A new benchmark", 2020, 3, None, "cs.LG", None, None, None), "MAYBE_BENCHMARK"),
        (("Metabolic pathway design", 2020, 3, None, "q-bio.BM", None, None, None), "BIOCHEM_ML"),
        (("Protein folding", 2020, 3, None, "q-bio.BM", None, None, None), "CAT_PRIMARY_APPLIED"),
        (("Retrosynthesis with nets", 2020, 3, None, None, None, None, None), "REACTION_ML"),
        (("X", 2020, 3, None, "cs.CV", None, None, None), "CAT_PRIMARY_APPLIED"),
        (("X", 2020, 3, None, "cs.CV", ["cs.CV", "cs.LG"], None, None), "CAT_PRIMARY_APPLIED"),
        (("X", 2020, 3, None, "cs.IR", ["cs.LG"], None, None), "CAT_PRIMARY_BORDERLINE"),
        (("X", 2020, 3, None, None, ["cs.CV", "cs.LG"], None, None), "CAT_CROSS_CORE"),
        (("X", 2020, 3, None, "", ["cs.LG"], None, None), "CAT_CROSS_CORE"),
        (("X", 2020, 3, "International Conference on Learning Representations", None, None, None, None), "VENUE_CORE"),
        (("X", 2020, 3, "Oracle Reports", None, None, ["History"], None), "NO_SIGNAL"),
        (("X", 2020, 3, None, "q-bio.BM", None, None, None), "CAT_PRIMARY_APPLIED"),
        (("X", 2020, 3, None, "cs.IR", None, None, None), "CAT_PRIMARY_BORDERLINE"),
        (("X", 2020, 3, None, "hep-th", None, None, None), "CAT_NOT_ALLOWED"),
        (("X", 2020, 3, "Proc. of ICML 2020", None, None, None, None), "VENUE_CORE"),
        (("X", 2020, 3, None, None, None, [" Computer Science "], None), "FIELD_CS_ONLY"),
        (("X", 2020, 3, None, None, None, ["Medicine"], None), "FIELD_NON_CS"),
        (("X", 2020, 3, "Nature", None, None, ["Medicine", "Computer Science"], None), "NO_SIGNAL"),
    ],
)
def test_cascade(spark, paper, reason):
    row = filters.cascade(spark.createDataFrame([(1, *paper)], PAPER), DEFAULT, 2026).first()
    assert row["verdict"]["reason"] == reason


def test_verdict_store(spark):
    kind = "paper_id long, session_id long, outcome string, stage string, reason string, config_version string"
    old = spark.createDataFrame([(1, None, "REJECT", "ERA", "PRE_ERA", DEFAULT.version), (2, 5, "REJECT", "T", "R", DEFAULT.version), (3, None, "REJECT", "T", "R", "old")], kind)
    papers = spark.createDataFrame([(i, "t", 2020, 1, None, "cs.LG", None, None, None) for i in (1, 2, 3)], PAPER)
    hit = as_map(filters.cached_cascade(papers, old, DEFAULT, 2026), v="hit")
    assert hit == {1: True, 2: False, 3: False}
    assert {r[0] for r in filters.non_accepted(old, 5, DEFAULT.version).collect()} == {1, 2}
    fresh = old.where("paper_id = 1").withColumn("outcome", F.lit("ACCEPT"))
    assert as_map(filters.record(old, fresh), v="outcome") == {1: "ACCEPT", 2: "REJECT", 3: "REJECT"}


def test_policy():
    changed = DEFAULT.merged(weights={"hub": 0.0})
    assert changed.weights["hub"] == 0.0 and changed.weights["overlap"] == 2.0
    assert changed.version != DEFAULT.version and len(DEFAULT.version) == 12 and Policy().version == DEFAULT.version


def test_pagerank_golden(spark):
    assert as_map(graph.pagerank(ids(spark, [1, 2]), edges(spark, [(1, 2), (2, 1)]), 3)) == pytest.approx({1: 0.5, 2: 0.5})
    pairs = [(i, 0) for i in range(1, 5)] + [(1, 2)]
    rank = dict.fromkeys(range(5), 0.2)
    for _ in range(5):
        out = {i: [b for a, b in pairs if a == i] for i in rank}
        lost = sum(r for i, r in rank.items() if not out[i])
        rank = {i: 0.03 + 0.85 * (lost / 5 + sum(rank[a] / len(out[a]) for a, b in pairs if b == i)) for i in rank}
    assert as_map(graph.pagerank(ids(spark, range(5)), edges(spark, pairs), 5)) == pytest.approx(rank)
    assert graph.pagerank(ids(spark, []), edges(spark, []), 3).collect() == []
    with pytest.raises(ValueError):
        graph.pagerank(ids(spark, [1]), edges(spark, []), 1, restart=ids(spark, [9]))


def test_components_stats_reach(spark):
    e, n = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (8, 7), (2, 1)]), ids(spark, range(1, 10))
    assert as_map(graph.components(n, e)) == {**dict.fromkeys(range(1, 7), 1), 7: 7, 8: 7, 9: 9}
    s = graph.stats(n, e).first()
    assert (s["nodes"], s["edges"], s["components"], s["avg_degree"]) == (9, 6, 3, round(12 / 9, 4))
    assert as_map(graph.reach(e, ids(spark, [1]), 3)) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert len(as_map(graph.reach(e, ids(spark, [1]), None))) == 6
    assert as_map(graph.degrees(n, e), v="in_degree")[9] == 0
    assert graph.completeness(n.withColumn("crawl_state", F.lit("STUB")).limit(0)).first()[0] == 0.0


def test_sweep(spark):
    n = spark.createDataFrame([(1, "LIKED"), (2, "CANDIDATE"), (3, "CANDIDATE"), (4, "CANDIDATE"), (5, "CANDIDATE"), (6, "CANDIDATE"), (7, "DISLIKED")], "paper_id long, state string")
    e = edges(spark, [(1, 2), (3, 2), (4, 3), (5, 4)])
    assert {r[0] for r in graph.sweep(n, e, ids(spark, [6]), 3).collect()} == {5}


def test_coupling_through_a_boundary_paper(spark):
    e = edges(spark, [(1, 9), (2, 9), (2, 8), (1, 8), (3, 7), (9, 1)])
    assert as_map(graph.coupling(e, ids(spark, [1]))) == {2: 2}
    assert as_map(graph.cocitation(edges(spark, [(9, 1), (9, 2), (8, 1), (8, 2), (7, 3)]), ids(spark, [1]))) == {2: 2}
    assert graph.incident(e, ids(spark, [1])).count() == 3


def test_events(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, "SEED_ADDED", "USER", 0), (2, 1, 2, "LIKED", "USER", 1), (3, 1, 2, "REMOVED", "USER", 2), (4, 1, 3, "LIKED", "USER", 1), (5, 1, 3, "UNLABELED", "SYSTEM", 1), (6, 1, 4, "LIKED", "USER", 1), (7, 1, 4, "CLEARED", "USER", 1), (9, 1, 2, "RESTORED", "USER", 9), (8, 1, 5, "GC_SWEPT", "SYSTEM", 3)],
        "id long, session_id long, paper_id long, event_type string, actor string, depth int",
    )
    assert as_map(events.replay(log)) == {1: "SEED", 2: "CANDIDATE", 3: "CANDIDATE"}
    assert {r["paper_id"] for r in events.tombstones(log).collect()} == {5}
    assert {r["paper_id"] for r in events.user_held(log).collect()} == {1, 2, 4}
    assert as_map(events.depth_at_removal(log)) == {1: 1, 2: 2, 3: 1, 4: 1, 5: 3}
    nodes = spark.createDataFrame([(1, 1, "LIKED"), (1, 2, "CANDIDATE"), (1, 4, "LIKED"), (1, 77, "LIKED")], "session_id long, paper_id long, state string")
    assert as_map(events.drift(log, nodes)) == {1: "SEED", 4: None}
    asked = spark.createDataFrame([(1, 1, "DISLIKED"), (1, 2, "SEED"), (1, 4, "CANDIDATE"), (1, 6, "LIKED"), (1, 77, "X")], "session_id long, paper_id long, to_state string")
    out = {r["paper_id"]: r for r in events.apply_labels(nodes, asked).collect()}
    assert out[1]["changes"] and out[1]["sweep"] and out[2]["error"] == "CANNOT_PROMOTE_TO_SEED"
    assert out[4]["event"] == "UNLABELED" and out[6]["error"] == "NOT_IN_GRAPH" and out[77]["error"] == "UNKNOWN_STATE"
    left, fresh = events.clear(nodes, 1)
    assert left.count() == 0 and fresh.count() == 4
    assert events.transitions(spark).count() == 16


def test_streaming_replay(spark, tmp_path):
    kind = "id long, session_id long, paper_id long, event_type string"
    spark.createDataFrame([(5, 1, 1, "REMOVED"), (2, 1, 2, "LIKED")], kind).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(3, 1, 1, "LIKED"), (9, 1, 2, "UNLABELED")], kind).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
    q = replay_stream(stream).writeStream.outputMode("complete").format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert as_map(spark.table("replayed")) == {1: None, 2: "CANDIDATE"}


def test_edge_merge(spark):
    kind = "citing_id long, cited_id long, discovered_via string, is_influential boolean, intents array<string>, first_seen_at string, seq long"
    rows = [(1, 2, "BACKWARD", None, None, "a", 1), (1, 2, "FORWARD", True, ["b", "a"], "b", 2), (3, 3, "BACKWARD", None, None, "a", 1), (4, 5, "FORWARD", None, None, "z", 9), (1, 2, "FORWARD", False, ["c"], "c", 3)]
    got = {r["citing_id"]: r for r in corpus.merge_edges(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1]["discovered_via"], got[1]["is_influential"], got[1]["intents"], got[1]["first_seen_at"]) == ("BOTH", True, ["a", "b", "c"], "a")
    assert got[4]["intents"] is None and got[4]["is_influential"] is None and 3 not in got


def test_paper_merge(spark):
    kind = "paper_id long, crawl_state string, citation_count long, venue string, year int, first_seen_at string, seq long"
    rows = [(1, "METADATA", 5, "V", 2000, "a", 1), (1, "STUB", 0, None, None, "b", 2), (1, "METADATA", 7, None, 2001, "c", 3)]
    r = corpus.merge_papers(spark.createDataFrame(rows, kind)).first()
    assert (r["crawl_state"], r["citation_count"], r["venue"], r["year"], r["first_seen_at"]) == ("METADATA", 7, "V", 2001, "a")


def test_percentiles(spark):
    rows = spark.createDataFrame([(1, 3.0), (1, 5.0), (1, 9.0), (1, 190000.0), (1, 5.0), (2, 4.0), (2, None)], "s int, v double")
    got = sorted((r["s"], r["v"] or 0, r["p"]) for r in ranking.rank_percentile(rows, "v", "p", ["s"]).collect())
    assert [x[2] for x in got if x[0] == 1] == pytest.approx([0, 1 / 3, 1 / 3, 2 / 3, 1])
    assert [x[2] for x in got if x[0] == 2] == [None, 0.5]


def pick(i, score=1.0, age=5.0, way="BACKWARD", sources=(1,)):
    return {"paper_id": i, "score": score, "age_years": age, "direction": way, "sources": list(sources)}


def test_allocation_invariants():
    pool = [pick(i, 100 - i, 0.5 if i % 10 == 0 else 5, "FORWARD" if i % 5 == 0 else "BACKWARD", [i % 4]) for i in range(100)]
    got = ranking.choose(pool, 20, DEFAULT)
    assert len(got) == 20 and sum(p["age_years"] < 1 for p in got) >= 3
    assert max(sum(s in p["sources"] for p in got) for s in range(4)) <= 8
    one = [pick(i, 100 - i) for i in range(50)]
    assert len(ranking.choose(one, 20, DEFAULT)) == 20  # the cap gives way rather than leave places empty
    assert ranking.choose([pick(1, -1.0)], 5, DEFAULT) == [] and ranking.choose(pool, 0, DEFAULT) == []
    import random

    for seed in range(5):
        mixed = pool[:]
        random.Random(seed).shuffle(mixed)
        assert ranking.choose(mixed, 20, DEFAULT) == got


def test_allocate_reaches_the_same_choice(spark):
    pool = [pick(i, float(i * 37 % 101), 0.5 if i % 13 == 0 else 4.0, "FORWARD" if i % 3 else "BACKWARD", [i % 7]) for i in range(300)]
    table = spark.createDataFrame([(1, p["paper_id"], p["score"], p["age_years"], p["direction"], p["sources"]) for p in pool], "session_id long, paper_id long, score double, age_years double, direction string, sources array<long>")
    got = [r["paper_id"] for r in ranking.allocate(table, 10, DEFAULT).orderBy("position").collect()]
    assert got == [p["paper_id"] for p in ranking.choose(pool, 10, DEFAULT)]


def test_allocate_refills_beyond_a_hot_source(spark):
    """One source holds the best 500 rows of both lanes, over 8 times the budget."""
    hot = [pick(i, 1000.0 - i, 4.0, "FORWARD" if i % 2 else "BACKWARD", [1]) for i in range(500)]
    rest = [pick(500 + i, 100.0 - i, 4.0, "FORWARD" if i % 2 else "BACKWARD", [2 + i % 5, 7 + i % 3][: 1 + i % 2]) for i in range(90)]
    pool = hot + rest
    table = spark.createDataFrame([(1, p["paper_id"], p["score"], p["age_years"], p["direction"], p["sources"]) for p in pool], "session_id long, paper_id long, score double, age_years double, direction string, sources array<long>")
    got = [r["paper_id"] for r in ranking.allocate(table, 20, DEFAULT).orderBy("position").collect()]
    assert got == [p["paper_id"] for p in ranking.choose(pool, 20, DEFAULT)]
    assert sum(i < 500 for i in got) == 8 and len(got) == 20


def test_prescore(spark):
    row = lambda *v: spark.createDataFrame([v], "o int, c long, a double").select(scores.prescore(F.col("o"), F.lit(False), F.lit(None).cast("boolean"), F.col("c"), F.col("a"), 2000)).first()[0]
    assert row(2, 0, 5.0) - row(1, 0, 5.0) == pytest.approx(2.0)
    assert row(1, 0, 1.49) - row(1, 0, 1.5) == pytest.approx(0.3)
    assert row(1, 3000, 9.0) == pytest.approx(2 + 0.4 * math.log1p(3000 / 9) / 5 - 0.6 * math.log1p(1000) / 10)


def test_text_functions(spark):
    t = spark.createDataFrame([("  The Café:  Études ", "de la Peña")], "t string, n string")
    r = t.select(text.normalize_title(F.col("t")).alias("a"), text.surname_of(F.col("n")).alias("b"), text.redact_secrets(F.lit("x api_key=abc&y")).alias("c"), text.shorten(F.lit("one two three four five six seven eight nine"), 20).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("cafe etudes", "peña", "x api_key=***&y", "one two three four…")
    key = lambda **k: t.select(text.canonical_key(*[F.lit(k.get(n)).cast("string") for n in ("doi", "arxiv", "title", "author")], F.lit(2020)).alias("k")).first()["k"]
    assert key(doi=" ", arxiv="2001.1v3")["v"] == key(arxiv="2001.1")["v"] == "2001.1"
    assert key(title="图 网络", author="A B")["v"] == "图 网络" and key(title="图", author="A B") != key(title="граф", author="A B")
    assert key(title="!?", author="A B") is None
    assert key(title="On X", author="A B") != key(title="Not on X", author="A B") and key(doi="10.1/A")["v"] == "10.1/a"


@pytest.mark.parametrize("value,first,last", [("2020", "2020-01-01", "2020-12-31"), ("2020-02", "2020-02-01", "2020-02-29"), ("2020-02-30", None, None), ("soon", None, None), (None, None, None), ("2020-13", None, None)])
def test_partial_dates(spark, value, first, last):
    r = spark.createDataFrame([(value,)], "d string").select(dates.earliest(F.col("d")).cast("string"), dates.latest(F.col("d")).cast("string"), dates.visible(F.col("d"), F.to_date(F.lit("2020-06-30")))).first()
    assert tuple(r)[:2] == (first, last) and r[2] is (last is not None and last <= "2020-06-30")


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3), (1, 12, 4), (3, 7, 1), (3, 7, 2), (3, 8, 3)], "case_id long, paper_id long, rank int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 5), (3, 8)], "case_id long, paper_id long")
    got = {r["case_id"]: r for r in evaluation.metrics(ranked, truth, 3).collect()}
    # the list is cut before repeats collapse, so 12 at place 4 is out
    assert got[1]["ndcg"] == pytest.approx(1 / (1 + 1 / math.log2(3))) and got[1]["recall"] == 0.5 and got[1]["rr"] == 1.0
    assert got[2]["recall"] == 0 and got[2]["ndcg"] == 0 and got[2]["hit"] == 0
    # the reciprocal rank counts places as they came, NDCG those after repeats collapsed
    assert got[3]["rr"] == pytest.approx(1 / 3) and got[3]["ndcg"] == pytest.approx(1 / math.log2(3))
    at2 = {r["case_id"]: r for r in evaluation.metrics(ranked, truth, 2).collect()}[3]
    assert (at2["recall"], at2["hit"], at2["ndcg"]) == (0, 0, 0) and at2["rr"] == pytest.approx(1 / 3)
    low, high = evaluation.interval([0.0, 1.0] * 20)
    assert low < 0.5 < high and evaluation.interval([]) == (0.0, 0.0)


def test_cases_do_not_depend_on_order(spark):
    rows = [(1, i, f"20{i:02d}" if i % 2 else f"20{i:02d}-02") for i in range(2, 22)] + [(1, 1, "2030"), (30, 2, "2000"), *((40, i, None) for i in range(2, 22))]
    e = spark.createDataFrame(rows, "citing_id long, cited_id long, date string")
    a = evaluation.make_cases(ids(spark, [1, 30, 40]), e).collect()
    b = evaluation.make_cases(ids(spark, [1, 30, 40]), e.orderBy(F.desc("cited_id"))).collect()
    assert a == b and len(a) == 1 and len(a[0]["seed_ids"]) == 3 and not set(a[0]["seed_ids"]) & set(a[0]["truth_ids"])
    assert len(a[0]["truth_ids"]) == 17
    last = max(a[0]["seed_ids"])
    assert a[0]["cutoff"] == (f"20{last:02d}-12-31" if last % 2 else f"20{last:02d}-02-{29 if last % 4 == 0 else 28}")


def test_numbered_without_one_task(spark):
    from biblioloom.operators.lineage import numbered

    got = numbered(spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v")), ["v"], "n").collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(i, i + 1) for i in range(5000)]


def test_feature_plan_stays_small(spark):
    """Every feature's percentile comes from one pass: the plan does not double with each of them."""
    papers = spark.createDataFrame([(i, "t", 2000 + i % 9, i * 3, "ICML" if i % 2 else None) for i in range(30)], "paper_id long, title string, year int, citation_count long, venue string")
    e = edges(spark, [(i, j) for i in range(30) for j in range(i) if (i * j) % 5 == 1])
    made = ranking.feature_pass(papers, e, ids(spark, [1, 2]), DEFAULT, 2026)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") < 10 and made.count() == 30
    assert made.agg(F.min("quality"), F.max("quality")).first() == (0.0, 1.0)


def test_removal_and_restoration(spark):
    log = spark.createDataFrame([(1, 1, 5, "SEED_ADDED", "USER", 0), (2, 1, 6, "GC_SWEPT", "SYSTEM", 3)], "id long, session_id long, paper_id long, event_type string, actor string, depth int")
    nodes = spark.createDataFrame([(1, 5, "SEED", 2)], "session_id long, paper_id long, state string, depth int")
    both = spark.createDataFrame([(1, 5), (1, 9)], "session_id long, paper_id long")
    left, more = events.remove(nodes, log, both)
    assert left.count() == 0 and more.count() == 3 and more.where("id = 3").first()["depth"] == 2
    back, last, refused = events.restore(left, more, both.unionByName(spark.createDataFrame([(1, 6)], both.schema)))
    assert {(r["paper_id"], r["state"], r["depth"]) for r in back.collect()} == {(5, "CANDIDATE", 2), (6, "CANDIDATE", 3)}
    assert last.count() == 5 and [r["paper_id"] for r in refused.collect()] == [9]
    assert events.parse_states(" seed, ,LIKED") == ["SEED", "LIKED"] and events.parse_states(" ") is None
    assert events.in_states(nodes, []).count() == 0 and events.in_states(nodes, None).count() == 1
    with pytest.raises(ValueError):
        events.parse_states("SEDE")


def test_signals_are_absent_below_the_floor(spark):
    nodes = spark.createDataFrame([(1, "METADATA"), (2, "METADATA"), (3, "STUB")], "paper_id long, crawl_state string")
    e = edges(spark, [(1, 2), (2, 1), (1, 3)])
    got = {r["paper_id"]: (r["in_degree"], r["rank"]) for r in graph.signals(nodes, e, 0.6).collect()}
    assert got[3] == (1, None) and got[1][1] == pytest.approx(0.5)
    assert all(r["rank"] is None and r["in_degree"] == 1 for r in graph.signals(nodes, e, 0.7).collect())
    assert sum(as_map(graph.plain_pagerank(nodes, e)).values()) == pytest.approx(1.0)


def test_zipped_snapshot_and_offline_cache(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/s.zip", "w") as z:
        z.writestr("a.json", '{"id":"1","categories":"cs.LG","update_date":"2020"}\n{bad\n')
    assert [r["arxiv_id"] for r in metadata.read_snapshot(spark, f"{tmp_path}/s.zip").collect()] == ["1"]
    asked = spark.createDataFrame([("/p", {"id": "7"})], "endpoint string, params map<string,string>")
    none = spark.createDataFrame([], "endpoint string, params_hash string, status_code int, response string, fetched_at string")
    assert metadata.cache_get(none, asked).first()["hit"] is False
    with pytest.raises(Exception, match="not in the cache"):
        metadata.cache_get(none, asked, offline=True).collect()
    assert metadata.harvest_params("2020-01-01") == {"verb": "ListRecords", "metadataPrefix": "arXiv", "set": "cs", "from": "2020-01-01"}
    assert metadata.harvest_params(token="t") == {"verb": "ListRecords", "resumptionToken": "t"}


def test_policy_file(tmp_path):
    from biblioloom import config

    (tmp_path / "p.json").write_text('{"year_floor": 2010, "core_allow": ["cs.LG"], "weights": {"hub": 0}}')
    p = config.load(str(tmp_path / "p.json"))
    assert p.year_floor == 2010 and p.core_allow == ("cs.LG",) and p.weights["overlap"] == 2.0 and p.version != DEFAULT.version


def test_sources(spark):
    lines = spark.createDataFrame([('{"id":"1","categories":"cs.LG cs.AI","update_date":"2020"}',), ("{bad",), ('{"id":"2","categories":""}',), ('{"categories":"x"}',)], "value string")
    assert [tuple(r)[:2] for r in metadata.snapshot(lines).collect()] == [("1", "cs.LG")]
    xml = spark.createDataFrame([("<arXiv><id>1</id><categories>cs.LG</categories><created>2019</created></arXiv>",)], "value string")
    assert metadata.harvest(xml).first()["updated"] == "2019"
    page = '{"data":[{"citedPaper":{"paperId":"b"},"isInfluential":true},{"citedPaper":{"paperId":"a"}},{"citedPaper":null}]}'
    got = metadata.neighbour_edges(spark.createDataFrame([("a", "BACKWARD", page)], "center string, direction string, value string")).collect()
    assert [(r["citing"], r["cited"]) for r in got] == [("a", "b")]
    listing = spark.createDataFrame([(0, "﻿First"), (1, "# no"), (2, " "), (3, "first "), (4, "Second")], "pos long, value string")
    assert sorted(r["title"] for r in metadata.reading_list(listing).collect()) == ["First", "Second"]


def test_views(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0, "b": -2.0, "c": float("nan")})], "id int, t map<string,double>")
    assert [(r["term"], r["width"], r["sign"]) for r in legacy.score_bars(rows, "id", "t").orderBy("place").collect()] == [("b", 1.0, "negative"), ("a", 0.5, "positive")]
    years = spark.createDataFrame([(2000,), (2010,), (None,)], "y int")
    assert sorted(r["shade"] for r in legacy.year_shade(years, "y").collect()) == [0.0, 0.5, 1.0]
