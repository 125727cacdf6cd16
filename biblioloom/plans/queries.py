"""Registered queries of the library: each applies an operator to the proxy corpus, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioloom.config import AS_OF_YEAR, DEFAULT, PROXY, GateTerms
from biblioloom.functions import dates, scores, text
from biblioloom.operators import corpus, evaluation, events, filters, graph, legacy, ranking, runs
from biblioloom.operators.lineage import cut, numbered, written
from biblioloom.plans import proxy
from biblioloom.sources import metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Data:
    """The tables of one scale factor, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("px_"):
            made = proxy.frame(self.spark, self.sf_dir, name)
            setattr(self, name, made)
            return made
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        QUERIES[name].of = f
        if sql is not None:
            ORACLE_SQL[name] = proxy.with_views(sql)
        return f

    return keep


def nodes_of(d: Data, session: int) -> DataFrame:
    return events.replay(d.px_events).where(F.col("session_id") == session)


# Shared SQL fragments -------------------------------------------------------------------------

REPLAY = """
last_known AS (SELECT session_id, paper_id, arg_max(event_type, id) AS event_type FROM px_events GROUP BY session_id, paper_id),
px_nodes AS (SELECT session_id, paper_id, CASE event_type WHEN 'SEED_ADDED' THEN 'SEED' WHEN 'LIKED' THEN 'LIKED' ELSE 'CANDIDATE' END AS state
  FROM last_known WHERE event_type NOT IN ('REMOVED', 'GC_SWEPT'))"""
RATE = "CASE WHEN year IS NULL THEN CAST(citation_count AS DOUBLE) ELSE citation_count / greatest(1, 2001 - year + 1) END"
RECENCY = "CASE WHEN year IS NULL THEN 0.0 ELSE pow(2.0, -greatest(0, 2001 - year) / 4.0) END"
PRESCORE = """2.0 * anchor_overlap + 0.8 * CAST(list_contains(intents, 'methodology') AS INT) + 0.5 * CAST(is_influential AS INT)
  + 0.4 * ln(1 + citation_count / greatest(0.5, age_years)) / 5 + 0.3 * CAST(age_years < 1.5 AS INT)
  - 0.6 * ln(1 + greatest(0, citation_count - 40)) / 10"""
POOL = """
own AS (SELECT paper_id FROM px_anchors),
way AS (
  SELECT cited_id AS paper_id, citing_id AS anchor, 'BACKWARD' AS direction, intents, is_influential FROM px_cites WHERE citing_id IN (SELECT paper_id FROM own)
  UNION ALL SELECT citing_id, cited_id, 'FORWARD', intents, is_influential FROM px_cites WHERE cited_id IN (SELECT paper_id FROM own)
    AND cited_id NOT IN (SELECT paper_id FROM px_papers WHERE citation_count > 40)),
grouped AS (
  SELECT paper_id, count(DISTINCT anchor) AS anchor_overlap, min(direction) AS direction, list_sort(list(DISTINCT anchor)) AS sources,
    list_sort(list_distinct(flatten(list(intents)))) AS intents, bool_or(is_influential) AS is_influential
  FROM way WHERE paper_id NOT IN (SELECT paper_id FROM own) AND paper_id NOT IN (SELECT paper_id FROM px_events WHERE event_type = 'GC_SWEPT')
  GROUP BY paper_id),
pool AS (SELECT g.*, p.title, p.year, p.citation_count, greatest(0.0, coalesce(CAST(2001 - p.year AS DOUBLE), 99.0)) AS age_years
  FROM grouped g JOIN px_papers p ON p.paper_id = g.paper_id)"""


def pool_of(d: Data) -> DataFrame:
    swept = d.px_events.where("event_type = 'GC_SWEPT'").select("paper_id")
    return ranking.build_pool(cut(d.px_cites), d.px_papers, d.px_anchors, swept, PROXY, AS_OF_YEAR)


# Pooling, ranking, pages ----------------------------------------------------------------------


@query("k01_candidate_page", f"""WITH {POOL}
SELECT paper_id, title, anchor_overlap, direction, citation_count, year, round({PRESCORE}, 6) AS prescore, count(*) OVER () AS total FROM pool
ORDER BY {PRESCORE} DESC, paper_id LIMIT 50""")
def candidate_page(d):
    rows = pool_of(d).select("paper_id", "title", "anchor_overlap", "direction", "citation_count", "year", F.round("prescore", 6).alias("prescore"))
    return ranking.page(rows, ranking.candidate_order("prescore"), 0, 50)


@query("k01_page_by_year", f"WITH {POOL} SELECT paper_id, year, count(*) OVER () AS total FROM pool ORDER BY year DESC NULLS LAST, paper_id LIMIT 25 OFFSET 25")
def page_by_year(d):
    return ranking.page(pool_of(d).select("paper_id", "year"), ranking.candidate_order("year"), 25, 25)


@query("k01_page_by_citations", f"WITH {POOL} SELECT paper_id, citation_count, count(*) OVER () AS total FROM pool ORDER BY citation_count DESC NULLS LAST, paper_id LIMIT 25")
def page_by_citations(d):
    return ranking.page(pool_of(d).select("paper_id", "citation_count"), ranking.candidate_order("citation_count"), 0, 25)


@query("r05_build_pool", f"WITH {POOL} SELECT paper_id, anchor_overlap, direction, array_to_string(sources, ',') AS sources, array_to_string(intents, ',') AS intents, is_influential, age_years FROM pool")
def build_pool(d):
    sources = F.concat_ws(",", F.transform("sources", lambda s: s.cast("string"))).alias("sources")
    return pool_of(d).select("paper_id", "anchor_overlap", "direction", sources, F.concat_ws(",", "intents").alias("intents"), "is_influential", "age_years")


@query("r04_prescore", f"WITH {POOL} SELECT paper_id, round({PRESCORE}, 6) AS prescore FROM pool")
def prescore(d):
    return pool_of(d).select("paper_id", F.round("prescore", 6).alias("prescore"))


@query("g09_anchor_overlap", """WITH pair AS (
  SELECT citing_id AS a, cited_id AS p FROM px_edges UNION ALL SELECT cited_id, citing_id FROM px_edges)
SELECT p AS paper_id, count(DISTINCT a) AS anchor_overlap FROM pair WHERE a IN (SELECT paper_id FROM px_anchors) GROUP BY p""")
def anchor_overlap(d):
    near = legacy.neighbours(d.px_edges, d.px_anchors)
    return near.groupBy(F.col("other").alias("paper_id")).agg(F.countDistinct("paper_id").alias("anchor_overlap"))


@query("k02_top_candidates", f"WITH {POOL} SELECT paper_id, round({PRESCORE}, 6) AS score FROM pool ORDER BY {PRESCORE} DESC, paper_id LIMIT 20")
def top_candidates(d):
    return pool_of(d).select("paper_id", F.round("prescore", 6).alias("score")).orderBy(F.desc("score"), "paper_id").limit(20)


@query("r06_r07_allocate")
def allocate(d):
    pool = pool_of(d).withColumn("session_id", F.lit(1)).withColumn("score", F.round("prescore", 6))
    return ranking.allocate(pool.select("session_id", "paper_id", "score", "age_years", "direction", "sources"), 20, PROXY)


@query("w04_rank_percentile", """WITH v AS (SELECT DISTINCT p_type, p_retailprice FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS n FROM v)
SELECT p.p_partkey, round(CASE WHEN n = 1 THEN 0.5 ELSE i / CAST(n - 1 AS DOUBLE) END, 9) AS pct
FROM part p JOIN r ON r.p_type = p.p_type AND r.p_retailprice = p.p_retailprice""")
def percentile(d):
    rows = ranking.rank_percentile(d.part.select("p_partkey", "p_type", "p_retailprice"), "p_retailprice", "pct", ["p_type"])
    return rows.select("p_partkey", F.round("pct", 9).alias("pct"))


FEATURES = f"""WITH own AS (SELECT paper_id FROM px_anchors),
pair AS (SELECT citing_id AS a, cited_id AS p FROM px_edges UNION ALL SELECT cited_id, citing_id FROM px_edges),
ov AS (SELECT p AS paper_id, count(DISTINCT a) AS x FROM pair WHERE a IN (SELECT paper_id FROM own) GROUP BY p),
hb AS (SELECT cited_id AS paper_id, count(*) AS x FROM px_edges GROUP BY cited_id),
bc AS (SELECT e.citing_id AS paper_id, count(DISTINCT e.cited_id) AS x FROM px_edges e WHERE e.citing_id NOT IN (SELECT paper_id FROM own)
  AND e.cited_id IN (SELECT cited_id FROM px_edges WHERE citing_id IN (SELECT paper_id FROM own)) GROUP BY e.citing_id),
cc AS (SELECT e.cited_id AS paper_id, count(DISTINCT e.citing_id) AS x FROM px_edges e WHERE e.cited_id NOT IN (SELECT paper_id FROM own)
  AND e.citing_id IN (SELECT citing_id FROM px_edges WHERE cited_id IN (SELECT paper_id FROM own)) GROUP BY e.cited_id),
raw AS (SELECT p.paper_id, p.venue, coalesce(ov.x, 0) AS overlap, coalesce(hb.x, 0) AS hub, coalesce(bc.x, 0) AS bibcoup, coalesce(cc.x, 0) AS cocite,
  {RATE} AS quality, {RECENCY} AS recency FROM px_papers p LEFT JOIN ov USING (paper_id) LEFT JOIN hb USING (paper_id)
  LEFT JOIN bc USING (paper_id) LEFT JOIN cc USING (paper_id)),
pct AS (SELECT paper_id, CASE WHEN venue IN ('Brand#11', 'Brand#22') THEN 1.0 ELSE 0.0 END AS venue, """ + ", ".join(
    f"CASE WHEN max(d_{c}) OVER () = 1 THEN 0.5 ELSE (d_{c} - 1) / CAST(max(d_{c}) OVER () - 1 AS DOUBLE) END AS {c}"
    for c in ("overlap", "hub", "bibcoup", "cocite", "quality", "recency")
) + " FROM (SELECT *, " + ", ".join(f"dense_rank() OVER (ORDER BY {c}) AS d_{c}" for c in ("overlap", "hub", "bibcoup", "cocite", "quality", "recency")) + " FROM raw))"


@query("r08_feature_pass", FEATURES + """ SELECT paper_id, round(overlap, 6) AS overlap, round(hub, 6) AS hub, round(bibcoup, 6) AS bibcoup,
  round(cocite, 6) AS cocite, round(quality, 6) AS quality, round(recency, 6) AS recency, venue AS venue_hit,
  round(2.0 * overlap + 0.4 * quality + 0.3 * recency + 0.2 * venue - 0.6 * hub, 6) AS score FROM pct""")
def features(d):
    f = ranking.feature_pass(d.px_papers, d.px_edges, d.px_anchors, PROXY, AS_OF_YEAR)
    return f.select("paper_id", *[F.round(c, 6).alias(c) for c in ("overlap", "hub", "bibcoup", "cocite", "quality", "recency")], "venue_hit", F.round("score", 6).alias("score"))


#: Papers of session 1, some at a core venue under another name; edges from and to papers outside count for all features but ``hub``.
SESSION_FEATURES = (
    FEATURES.replace("WITH own AS", "WITH " + REPLAY.strip() + ",\nmine AS (SELECT paper_id FROM px_nodes WHERE session_id = 1),\nown AS", 1)
    .replace("FROM px_edges GROUP BY cited_id)", "FROM px_edges WHERE citing_id IN (SELECT paper_id FROM mine) GROUP BY cited_id)", 1)
    .replace("USING (paper_id)),\npct", "USING (paper_id) WHERE p.paper_id IN (SELECT paper_id FROM mine)),\npct", 1)
    .replace("venue IN ('Brand#11', 'Brand#22')", "venue IN ('Brand#11', 'Brand#22', 'Brand#3')", 1)
)


@query("r08_session_features", SESSION_FEATURES + """ SELECT paper_id, round(overlap, 6) AS overlap, round(hub, 6) AS hub, round(bibcoup, 6) AS bibcoup,
  round(cocite, 6) AS cocite, venue AS venue_hit, round(2.0 * overlap + 0.4 * quality + 0.3 * recency + 0.2 * venue - 0.6 * hub, 6) AS score FROM pct""")
def session_features(d):
    named = F.when(F.col("venue") == "Brand#3", "Proc. of the International Conference on Learning Representations").when(F.col("venue") == "Brand#11", "the brand#11 2003 workshops")
    papers = d.px_papers.join(nodes_of(d, 1).select("paper_id"), "paper_id", "left_semi").withColumn("venue", F.coalesce(named, "venue"))
    f = ranking.feature_pass(papers, d.px_edges, d.px_anchors, PROXY, AS_OF_YEAR)
    return f.select("paper_id", *[F.round(c, 6).alias(c) for c in ("overlap", "hub", "bibcoup", "cocite")], "venue_hit", F.round("score", 6).alias("score"))


@query("r09_rescore", f"SELECT paper_id, CASE WHEN citation_count > 20 THEN round(1.5 * ({RATE}) + 0.5 * ({RECENCY}), 6) END AS score FROM px_papers")
def rescore(d):
    p = d.px_papers
    made = F.create_map(F.lit("quality"), scores.ranked_rate(F.col("citation_count"), F.col("year"), AS_OF_YEAR), F.lit("recency"), scores.recency(F.col("year"), AS_OF_YEAR))
    rows = p.select("paper_id", F.when(F.col("citation_count") > 20, made).alias("features"))
    return ranking.rescore(rows, {"quality": 1.5, "recency": 0.5, "venue": 0.0}).select("paper_id", F.round("score", 6).alias("score"))


@query("r01_r02_rates", f"""SELECT paper_id, round({RATE}, 6) AS ranked_rate, round({RECENCY}, 6) AS recency,
  round(CASE WHEN year IS NULL THEN 0.0 ELSE citation_count / greatest(1, 2001 - year + 1) END, 6) AS survey_rate,
  round(citation_count / greatest(0.5, coalesce(CAST(2001 - year AS DOUBLE), 99.0)), 6) AS pool_rate FROM px_papers""")
def rates(d):
    c, y = F.col("citation_count"), F.col("year")
    made = {"ranked_rate": scores.ranked_rate(c, y, AS_OF_YEAR), "recency": scores.recency(y, AS_OF_YEAR), "survey_rate": scores.survey_rate(c, y, AS_OF_YEAR), "pool_rate": scores.pool_rate(c, scores.age(y, AS_OF_YEAR))}
    return d.px_papers.select("paper_id", *[F.round(v, 6).alias(n) for n, v in made.items()])


@query("r03_score_breakdown", FEATURES + """ SELECT paper_id, 'hub' AS term, round(-0.6 * hub, 6) AS value FROM pct UNION ALL
SELECT paper_id, 'overlap', round(2.0 * overlap, 6) FROM pct UNION ALL SELECT paper_id, 'quality', round(0.4 * quality, 6) FROM pct UNION ALL
SELECT paper_id, 'recency', round(0.3 * recency, 6) FROM pct UNION ALL SELECT paper_id, 'venue', round(0.2 * venue, 6) FROM pct""")
def breakdown(d):
    f = ranking.feature_pass(d.px_papers, d.px_edges, d.px_anchors, PROXY, AS_OF_YEAR)
    return f.select("paper_id", F.explode("breakdown").alias("term", "value")).select("paper_id", "term", F.round("value", 6).alias("value"))


@query("r10_weight_sweep", f"""SELECT paper_id, w.w AS weight, round(w.w * ({RATE}), 6) AS score FROM px_papers, (VALUES (0.0), (0.5), (1.0)) w(w)""")
def weight_sweep(d):
    w = F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    return d.px_papers.withColumn("weight", w).select("paper_id", "weight", F.round(F.col("weight") * scores.ranked_rate(F.col("citation_count"), F.col("year"), AS_OF_YEAR), 6).alias("score"))


@query("r10_grid_sweep", f"""SELECT paper_id, g.run, round(g.a * ({RATE}) + g.b * ({RECENCY}), 6) AS score FROM px_papers, (VALUES (0, 0.4, 0.3), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, -0.5, 2.0)) g(run, a, b)""")
def grid_sweep(d):
    made = F.create_map(F.lit("quality"), scores.ranked_rate(F.col("citation_count"), F.col("year"), AS_OF_YEAR), F.lit("recency"), scores.recency(F.col("year"), AS_OF_YEAR))
    grid = [{"quality": a, "recency": b} for a, b in ((0.4, 0.3), (1.0, 0.0), (0.0, 1.0), (-0.5, 2.0))]
    return ranking.sweep(d.px_papers.select("paper_id", made.alias("features")), grid).select("paper_id", "run", F.round("score", 6).alias("score"))


# Graph ----------------------------------------------------------------------------------------


@query("j02_induced_edges", f"WITH {REPLAY} SELECT citing_id, cited_id FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_nodes WHERE session_id = 1) AND cited_id IN (SELECT paper_id FROM px_nodes WHERE session_id = 1)")
def induced_edges(d):
    return graph.induced(d.px_edges, nodes_of(d, 1))


@query("j04_incident_edges", "SELECT citing_id, cited_id FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors) OR cited_id IN (SELECT paper_id FROM px_anchors)")
def incident_edges(d):
    return graph.incident(d.px_edges, d.px_anchors)


@query("j05_coupling", """SELECT citing_id AS paper_id, count(DISTINCT cited_id) AS coupled FROM px_edges WHERE citing_id NOT IN (SELECT paper_id FROM px_anchors)
AND cited_id IN (SELECT cited_id FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors)) GROUP BY citing_id""")
def coupling(d):
    return graph.coupling(d.px_edges, d.px_anchors)


@query("j06_cocitation", """SELECT cited_id AS paper_id, count(DISTINCT citing_id) AS cocited FROM px_edges WHERE cited_id NOT IN (SELECT paper_id FROM px_anchors)
AND citing_id IN (SELECT citing_id FROM px_edges WHERE cited_id IN (SELECT paper_id FROM px_anchors)) GROUP BY cited_id""")
def cocitation(d):
    return graph.cocitation(d.px_edges, d.px_anchors)


@query("a07_degrees", """SELECT p.paper_id, (SELECT count(*) FROM px_edges e WHERE e.cited_id = p.paper_id) AS in_degree,
(SELECT count(*) FROM px_edges e WHERE e.citing_id = p.paper_id) AS out_degree FROM px_papers p""")
def degrees(d):
    return graph.degrees(d.px_papers, d.px_edges)


def rank_sql(edges: str, restart: str = "paper_id IS NOT NULL", most: int = 40, limit: str = "1e-6 * (SELECT count(*) FROM ids)", nodes: str = "crawl_state <> 'STUB'") -> str:
    """Power iteration over the papers that are no stubs, to the first step that changes less than ``limit`` in all (within ``most``)."""
    steps = [f"""ids AS (SELECT paper_id FROM px_papers WHERE {nodes}),
l AS (SELECT DISTINCT a, b FROM ({edges}) x WHERE a IN (SELECT paper_id FROM ids) AND b IN (SELECT paper_id FROM ids)),
o AS (SELECT a, count(*) AS n FROM l GROUP BY a), w AS MATERIALIZED (SELECT l.a, l.b, o.n FROM l JOIN o ON o.a = l.a),
b AS MATERIALIZED (SELECT paper_id, CASE WHEN {restart} THEN 1.0 / (SELECT count(*) FROM ids WHERE {restart}) ELSE 0.0 END AS s,
  paper_id NOT IN (SELECT a FROM o) AS dangling FROM ids), r0 AS MATERIALIZED (SELECT paper_id, s AS r FROM b)"""]
    for k in range(most):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT b.paper_id, 0.15 * b.s + 0.85 * (coalesce(g.x, 0) + b.s * (SELECT coalesce(sum(r.r), 0) FROM r{k} r JOIN b d ON d.paper_id = r.paper_id WHERE d.dangling)) AS r "
            f"FROM b LEFT JOIN (SELECT w.b AS paper_id, sum(r.r / w.n) AS x FROM w JOIN r{k} r ON r.paper_id = w.a GROUP BY w.b) g ON g.paper_id = b.paper_id)"
        )
    each = " UNION ALL ".join(f"SELECT {k + 1} AS step, sum(abs(x.r - y.r)) AS change FROM r{k + 1} x JOIN r{k} y ON y.paper_id = x.paper_id" for k in range(most))
    ranks = " UNION ALL ".join(f"SELECT {k + 1} AS step, * FROM r{k + 1}" for k in range(most))
    end = f"SELECT min(step) FROM ({each}) c WHERE change < {limit}"
    return "WITH " + ", ".join(steps) + f" SELECT paper_id, round(r, 9) AS rank FROM ({ranks}) z WHERE step = ({end})"


def converged(d: Data, edges: DataFrame, restart: DataFrame | None = None) -> DataFrame:
    """PageRank to its tolerance over the papers that are no stubs and the edges among them."""
    nodes = d.px_papers.where("crawl_state <> 'STUB'").select("paper_id")
    ranks = graph.pagerank(nodes, graph.induced(edges, nodes), 100, restart=restart, tolerance=1e-6)
    return ranks.select("paper_id", F.round("rank", 9).alias("rank"))


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("cited_id").alias("citing_id"), F.col("citing_id").alias("cited_id"))


@query("g02_pagerank", rank_sql("SELECT citing_id AS a, cited_id AS b FROM px_edges"))
def pagerank(d):
    return converged(d, d.px_edges)


@query("g03_reverse_pagerank", rank_sql("SELECT cited_id AS a, citing_id AS b FROM px_edges"))
def reverse_pagerank(d):
    return converged(d, turned(d.px_edges))


@query("g04_undirected_pagerank", rank_sql("SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges"))
def undirected_pagerank(d):
    return converged(d, d.px_edges.unionByName(turned(d.px_edges)))


@query("x14_personal_pagerank", rank_sql("SELECT citing_id AS a, cited_id AS b FROM px_edges", "paper_id IN (SELECT paper_id FROM px_anchors)"))
def personal_pagerank(d):
    return converged(d, d.px_edges, d.px_anchors)


@query("g05_completeness", "SELECT round(avg(CASE WHEN crawl_state <> 'STUB' THEN 1.0 ELSE 0.0 END), 4) AS completeness, avg(CASE WHEN crawl_state <> 'STUB' THEN 1.0 ELSE 0.0 END) < 0.6 AS suppressed FROM px_papers")
def completeness(d):
    return graph.completeness(d.px_papers).select("completeness", (F.col("completeness") < PROXY.completeness_floor).alias("suppressed"))


@query("g05_signals", rank_sql("SELECT citing_id AS a, cited_id AS b FROM px_edges").replace(" SELECT paper_id, round(r, 9) AS rank FROM (", """, z AS (SELECT paper_id, r, step FROM (""", 1).replace(") z WHERE step = (", ") zz WHERE step = (") + """)
SELECT p.paper_id, (SELECT count(*) FROM px_edges e WHERE e.cited_id = p.paper_id) AS in_degree, (SELECT count(*) FROM px_edges e WHERE e.citing_id = p.paper_id) AS out_degree, round(z.r, 9) AS rank
FROM px_papers p LEFT JOIN z ON z.paper_id = p.paper_id""")
def signals(d):
    return graph.signals(d.px_papers, d.px_edges, PROXY.completeness_floor).select("paper_id", "in_degree", "out_degree", F.round("rank", 9).alias("rank"))


@query("g05_suppressed", "SELECT paper_id, CAST(NULL AS DOUBLE) AS rank FROM px_papers")
def suppressed(d):
    return graph.signals(d.px_papers, d.px_edges, 0.95).select("paper_id", "rank")


@query("g11_plain_pagerank", rank_sql("SELECT citing_id AS a, cited_id AS b FROM px_edges", most=60, limit="1e-8", nodes="TRUE"))
def plain_pagerank(d):
    return graph.plain_pagerank(d.px_papers, d.px_edges).select("paper_id", F.round("rank", 9).alias("rank"))


@query("u06_undirected", "SELECT DISTINCT least(citing_id, cited_id) AS a, greatest(citing_id, cited_id) AS b FROM px_edges")
def undirected(d):
    return graph.undirected(d.px_edges)


def components_sql(most: int = 16) -> str:
    """Least labels of neighbours, step by step; ``most`` steps cross the test graphs."""
    steps = ["e AS MATERIALIZED (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges), c0 AS (SELECT paper_id, paper_id AS component FROM px_papers)"]
    for k in range(most):
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.paper_id, least(c.component, coalesce(min(n.component), c.component)) AS component FROM c{k} c LEFT JOIN e ON e.a = c.paper_id LEFT JOIN c{k} n ON n.paper_id = e.b GROUP BY c.paper_id, c.component)")
    return "WITH " + ", ".join(steps) + f", comp AS (SELECT * FROM c{most}) "


@query("g07_components", components_sql() + "SELECT paper_id, component FROM comp")
def components(d):
    return graph.components(d.px_papers, d.px_edges)


@query("g06_graph_stats", components_sql() + """, u AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM e)), n AS (SELECT count(*) AS n, count(DISTINCT component) AS k FROM comp)
SELECT n.n AS nodes, u.m AS edges, n.k AS components, round(2 * u.m / CAST(n.n AS DOUBLE), 4) AS avg_degree, round(2 * u.m / (CAST(n.n AS DOUBLE) * (n.n - 1)), 4) AS density FROM u, n""")
def graph_stats(d):
    return graph.stats(d.px_papers, d.px_edges)


@query("g08_reach", """WITH RECURSIVE e AS (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges),
walk AS (SELECT paper_id, 0 AS k FROM px_anchors UNION SELECT e.b, w.k + 1 FROM walk w JOIN e ON e.a = w.paper_id WHERE w.k < 3)
SELECT paper_id, min(k) AS distance FROM walk GROUP BY paper_id""")
def reach(d):
    return graph.reach(d.px_edges, d.px_anchors, 3)


@query("g08_sweep", f"""WITH RECURSIVE {REPLAY}, n AS (SELECT paper_id, state FROM px_nodes WHERE session_id = 1),
e AS (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges),
walk AS (SELECT paper_id, 0 AS k FROM n WHERE state IN ('SEED', 'LIKED') UNION
  SELECT e.b, w.k + 1 FROM walk w JOIN e ON e.a = w.paper_id JOIN n ON n.paper_id = e.b WHERE w.k < 3)
SELECT paper_id FROM n WHERE state = 'CANDIDATE' AND paper_id NOT IN (SELECT paper_id FROM walk) AND paper_id % 3 <> 0""")
def sweep(d):
    n = nodes_of(d, 1)
    return graph.sweep(n, d.px_edges, n.where("paper_id % 3 = 0"), 3)


@query("g10_hub_guard", "SELECT count(*) AS n FROM px_edges WHERE cited_id IN (SELECT paper_id FROM px_papers WHERE citation_count <= 40)")
def hub_guard(d):
    fine = d.px_papers.where(F.col("citation_count") <= PROXY.forward_expand_max).select(F.col("paper_id").alias("cited_id"))
    return d.px_edges.join(fine, "cited_id", "left_semi").agg(F.count("*").alias("n"))


@query("g12_seed_metrics", """WITH x AS (SELECT cited_id AS paper_id, 1 AS b, 0 AS t FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors)
UNION ALL SELECT citing_id, 0, 1 FROM px_edges WHERE cited_id IN (SELECT paper_id FROM px_anchors))
SELECT paper_id, CAST(sum(b) AS BIGINT) AS cited_by_seeds, CAST(sum(t) AS BIGINT) AS cites_seeds, CAST(sum(b + t) AS BIGINT) AS co_citation FROM x
WHERE paper_id NOT IN (SELECT paper_id FROM px_anchors) GROUP BY paper_id""")
def seed_metrics(d):
    return legacy.seed_metrics(d.px_edges, d.px_anchors)


@query("g13_expand_levels", """WITH n AS (SELECT citing_id AS p, cited_id AS o, 1 AS ref FROM px_edges UNION ALL SELECT cited_id, citing_id, 0 FROM px_edges),
c AS (SELECT paper_id, citation_count FROM px_papers), s0 AS (SELECT paper_id FROM px_anchors),
n1 AS (SELECT o AS paper_id, max(ref) AS ref FROM n WHERE p IN (SELECT paper_id FROM s0) AND o NOT IN (SELECT paper_id FROM s0) GROUP BY o),
b1 AS (SELECT n1.paper_id FROM n1 LEFT JOIN c ON c.paper_id = n1.paper_id ORDER BY coalesce(c.citation_count, 0) DESC, n1.paper_id LIMIT 25),
r1 AS (SELECT paper_id FROM b1 UNION SELECT paper_id FROM n1 WHERE ref = 1),
n2 AS (SELECT DISTINCT o AS paper_id FROM n WHERE p IN (SELECT paper_id FROM r1) AND o NOT IN (SELECT paper_id FROM s0) AND o NOT IN (SELECT paper_id FROM r1)),
r2 AS (SELECT n2.paper_id FROM n2 LEFT JOIN c ON c.paper_id = n2.paper_id ORDER BY coalesce(c.citation_count, 0) DESC, n2.paper_id LIMIT 25),
k1 AS (SELECT r1.paper_id, list(DISTINCT n.p) AS k FROM r1 JOIN n ON n.o = r1.paper_id WHERE n.p IN (SELECT paper_id FROM s0) GROUP BY r1.paper_id),
k2 AS (SELECT r2.paper_id, list_distinct(flatten(list(k1.k))) AS k FROM r2 JOIN n ON n.o = r2.paper_id JOIN k1 ON k1.paper_id = n.p GROUP BY r2.paper_id)
SELECT paper_id, 0 AS level, CAST(paper_id AS VARCHAR) AS connections FROM s0 UNION ALL SELECT paper_id, 1, array_to_string(list_sort(k), ',') FROM k1 UNION ALL SELECT paper_id, 2, array_to_string(list_sort(k), ',') FROM k2""")
def expand_levels(d):
    found = legacy.expand_levels(d.px_edges, d.px_anchors, 2, 25, d.px_papers)
    return found.select("paper_id", "level", F.concat_ws(",", F.transform("connections", lambda c: c.cast("string"))).alias("connections"))


@query("a14_neighbour_counts", "SELECT p AS paper_id, count(*) AS n FROM (SELECT citing_id AS p FROM px_edges UNION ALL SELECT cited_id FROM px_edges) GROUP BY p ORDER BY n, paper_id LIMIT 100")
def neighbour_counts(d):
    ends = d.px_edges.select(F.explode(F.array("citing_id", "cited_id")).alias("paper_id"))
    return ends.groupBy("paper_id").agg(F.count("*").alias("n")).orderBy("n", "paper_id").limit(100)


@query("j13_neighbours", "SELECT citing_id AS paper_id, cited_id AS other, 'out' AS direction FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors) UNION ALL SELECT cited_id, citing_id, 'in' FROM px_edges WHERE cited_id IN (SELECT paper_id FROM px_anchors)")
def neighbours(d):
    return legacy.neighbours(d.px_edges, d.px_anchors)


@query("j17_drawn_neighbours", f"""WITH {REPLAY}, n AS (SELECT paper_id FROM px_nodes WHERE session_id = 1)
SELECT x.paper_id, x.other, x.direction, p.title FROM (SELECT citing_id AS paper_id, cited_id AS other, 'cites' AS direction FROM px_edges
UNION ALL SELECT cited_id, citing_id, 'cited-by' FROM px_edges) x JOIN px_papers p ON p.paper_id = x.other WHERE x.other IN (SELECT paper_id FROM n) AND x.paper_id IN (SELECT paper_id FROM n)""")
def drawn_neighbours(d):
    n = nodes_of(d, 1).select("paper_id")
    drawn = legacy.neighbours(d.px_edges, n).join(n.withColumnRenamed("paper_id", "other"), "other", "left_semi")
    way = F.when(F.col("direction") == "out", "cites").otherwise("cited-by")
    named = drawn.join(d.px_papers.select(F.col("paper_id").alias("other"), "title"), "other")
    return named.select("paper_id", "other", way.alias("direction"), "title")


@query("j12_node_detail", f"""WITH {REPLAY}, n AS (SELECT paper_id FROM px_nodes WHERE session_id = 1)
SELECT 3 AS paper_id, count(*) FILTER (WHERE cited_id = 3 AND citing_id IN (SELECT paper_id FROM n)) AS in_degree,
count(*) FILTER (WHERE citing_id = 3 AND cited_id IN (SELECT paper_id FROM n)) AS out_degree FROM px_edges""")
def node_detail(d):
    near = legacy.neighbours(d.px_edges, d.px_papers.where("paper_id = 3"))
    drawn = near.join(nodes_of(d, 1).select(F.col("paper_id").alias("other")), "other", "left_semi")
    return drawn.agg(F.lit(3).alias("paper_id"), F.count_if(F.col("direction") == "in").alias("in_degree"), F.count_if(F.col("direction") == "out").alias("out_degree"))


@query("a13_indegree_ranking", "SELECT cited_id AS paper_id, count(*) AS n FROM px_edges WHERE cited_id % 4 = 1 GROUP BY cited_id ORDER BY n DESC, paper_id LIMIT 30")
def indegree_ranking(d):
    return legacy.indegree_ranking(d.px_edges, labelled(d), "liked", 30)


@query("j09_boundary_count", f"WITH {REPLAY} SELECT count(*) AS n FROM px_papers WHERE paper_id NOT IN (SELECT paper_id FROM px_nodes WHERE session_id = 1)")
def boundary_count(d):
    return d.px_papers.join(nodes_of(d, 1).select("paper_id"), "paper_id", "left_anti").agg(F.count("*").alias("n"))


# Filter cascade -------------------------------------------------------------------------------

TYPE_SQL = """CASE WHEN list_contains(types, 'dataset') THEN 'REJECT|TYPE|IS_DATASET'
  WHEN regexp_matches(title, '(?i)^(?:(?:a|an|the)\\s+)?(?:\\w+\\s+){0,2}(survey|review|overview)(\\s+(of|on|in|for)\\b|\\s*[:\\-]|$)') OR list_contains(types, 'review')
  THEN CASE WHEN citation_count >= 40 OR (year IS NOT NULL AND citation_count / greatest(1, 2001 - year + 1) >= 8.0) THEN 'ACCEPT|TYPE|SURVEY_WELL_CITED' ELSE 'REJECT|TYPE|LOW_CITE_SURVEY' END
  WHEN regexp_matches(title, '(?i)\\b(benchmark|benchmarks|dataset|datasets|test ?suite)\\b') THEN 'QUARANTINE|TYPE|MAYBE_BENCHMARK' ELSE 'ACCEPT|TYPE|OK' END"""
TOPIC_SQL = """CASE WHEN coalesce(category, '') NOT IN ('STANDARD', 'PROMO') AND contains(lower(title), 'metabolic pathway') THEN 'ACCEPT|TOPIC|BIOCHEM_ML'
  WHEN coalesce(category, '') NOT IN ('STANDARD', 'PROMO') AND contains(lower(title), 'retrosynth') THEN 'ACCEPT|TOPIC|REACTION_ML'
  WHEN category IN ('STANDARD', 'PROMO') THEN 'ACCEPT|TOPIC|CAT_PRIMARY_CORE' WHEN category = 'LARGE' OR starts_with(category, 'SMALL.') THEN 'REJECT|TOPIC|CAT_PRIMARY_APPLIED'
  WHEN category = 'MEDIUM' THEN 'QUARANTINE|TOPIC|CAT_PRIMARY_BORDERLINE' WHEN category IS NOT NULL THEN 'QUARANTINE|TOPIC|CAT_NOT_ALLOWED'
  WHEN list_contains(crossed, 'PROMO') THEN 'ACCEPT|TOPIC|CAT_CROSS_CORE'
  WHEN venue IN ('Brand#11', 'Brand#22') OR contains(lower(venue), 'learning representations') THEN 'ACCEPT|TOPIC|VENUE_CORE'
  WHEN fields = ['Computer Science'] THEN 'QUARANTINE|TOPIC|FIELD_CS_ONLY'
  WHEN list_contains(fields, 'Medicine') AND NOT list_contains(fields, 'Computer Science') THEN 'REJECT|TOPIC|FIELD_NON_CS' ELSE 'QUARANTINE|TOPIC|NO_SIGNAL' END"""
ERA_SQL = "CASE WHEN year IS NULL THEN 'QUARANTINE|ERA|YEAR_UNKNOWN' WHEN year < 1995 THEN 'REJECT|ERA|PRE_ERA' ELSE 'ACCEPT|ERA|OK' END"
#: Titles, types, categories, cross-lists, venues and fields that reach every rung. Both engines run it.
TITLED_ROWS = """SELECT paper_id, year, citation_count,
  CASE WHEN paper_id % 13 = 5 THEN 'Int. International Conference on Learning Representations' ELSE venue END AS venue,
  CASE WHEN paper_id % 3 = 0 THEN NULL WHEN paper_id % 17 = 1 THEN category || '.x' ELSE category END AS category,
  CASE paper_id % 5 WHEN 0 THEN array('LARGE', 'PROMO') WHEN 1 THEN array('LARGE') END AS crossed,
  CASE paper_id % 7 WHEN 0 THEN array('Computer Science') WHEN 1 THEN array('Medicine') WHEN 2 THEN array('Medicine', 'Computer Science')
    WHEN 3 THEN array('History') END AS fields,
  CASE paper_id % 19 WHEN 0 THEN array('dataset') WHEN 1 THEN array('review') END AS types,
  CASE paper_id % 11 WHEN 0 THEN 'A survey of ' || title WHEN 1 THEN title || ' dataset' WHEN 2 THEN 'Metabolic pathway of ' || title
    WHEN 3 THEN title || ' retrosynthesis' ELSE title END AS title FROM {papers}"""
TITLED = "titled AS (" + TITLED_ROWS.format(papers="px_papers").replace("array(", "list_value(") + ")"
CASCADE_SQL = f"""WITH {TITLED}, stage AS (SELECT *, {ERA_SQL} AS e, {TYPE_SQL} AS t, {TOPIC_SQL} AS o FROM titled),
judged AS (SELECT *, CASE WHEN e NOT LIKE 'ACCEPT%' THEN e WHEN t NOT LIKE 'ACCEPT%' THEN t ELSE o END AS v FROM stage) """


def titled(d: Data) -> DataFrame:
    return d.spark.sql(TITLED_ROWS.format(papers="{papers}"), papers=d.px_papers)


def told(v):
    return F.concat_ws("|", v["outcome"], v["stage"], v["reason"])


@query("f01_era", f"SELECT paper_id, {ERA_SQL} AS verdict FROM px_papers")
def era(d):
    return d.px_papers.select("paper_id", told(filters.era(F.col("year"), PROXY)).alias("verdict"))


@query("f02_f03_type", f"WITH {TITLED} SELECT paper_id, {TYPE_SQL} AS verdict FROM titled")
def kind(d):
    v = filters.paper_kind(F.col("title"), F.col("types"), F.col("citation_count"), F.col("year"), PROXY, AS_OF_YEAR)
    return titled(d).select("paper_id", told(v).alias("verdict"))


@query("f04_f09_topic", f"WITH {TITLED} SELECT paper_id, {TOPIC_SQL} AS verdict FROM titled")
def topic(d):
    made = filters.topic(*[F.col(c) for c in ("title", "category", "crossed", "venue", "fields")], PROXY)
    return titled(d).select("paper_id", told(made).alias("verdict"))


@query("f10_cascade", CASCADE_SQL + "SELECT paper_id, v AS verdict FROM judged")
def cascade(d):
    return filters.cascade(titled(d), PROXY, AS_OF_YEAR).select("paper_id", told(F.col("verdict")).alias("verdict"))


def decisions_of(d: Data) -> DataFrame:
    v = filters.cascade(titled(d), PROXY, AS_OF_YEAR)
    return v.select("paper_id", F.lit(None).cast("long").alias("session_id"), "verdict.*", F.lit(PROXY.version).alias("config_version"))


@query("f11_cached_cascade", CASCADE_SQL + "SELECT v AS verdict, count(*) FILTER (WHERE paper_id % 2 = 0 AND v LIKE 'REJECT%') AS hits, count(*) FILTER (WHERE NOT (paper_id % 2 = 0 AND v LIKE 'REJECT%')) AS evaluated FROM judged GROUP BY v")
def cached(d):
    old = decisions_of(d).where("paper_id % 2 = 0")  # the other half has not been judged before
    rows = filters.cached_cascade(titled(d), old, PROXY, AS_OF_YEAR)
    return rows.groupBy(told(F.col("verdict")).alias("verdict")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("evaluated"))


@query("f12_record", CASCADE_SQL + "SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN 'ACCEPT' ELSE split_part(v, '|', 1) END AS outcome FROM judged")
def record(d):
    old = decisions_of(d)
    fresh = old.where("paper_id % 4 = 0").withColumn("outcome", F.lit("ACCEPT"))
    return filters.record(old, fresh).select("paper_id", "outcome")


@query("f13_non_accepted", CASCADE_SQL + "SELECT paper_id FROM judged WHERE v NOT LIKE 'ACCEPT%'")
def non_accepted(d):
    return filters.non_accepted(decisions_of(d), 1, PROXY.version)


@query("f16_report", CASCADE_SQL + "SELECT split_part(v, '|', 1) AS outcome, split_part(v, '|', 3) AS reason, count(*) AS n FROM judged GROUP BY 1, 2")
def report(d):
    return filters.report(filters.cascade(titled(d), PROXY, AS_OF_YEAR))


@query("a03_count_by_reason", CASCADE_SQL + "SELECT split_part(v, '|', 1) AS outcome, split_part(v, '|', 3) AS reason, count(*) AS n FROM judged GROUP BY 1, 2")
def count_by_reason(d):
    return filters.count_by_reason(decisions_of(d)).orderBy(F.desc("n"), "reason")


@query("a03_count_by_reason_session", CASCADE_SQL + "SELECT split_part(v, '|', 1) AS outcome, split_part(v, '|', 3) AS reason, count(*) AS n FROM judged WHERE paper_id % 3 <> 2 GROUP BY 1, 2")
def count_by_reason_session(d):
    scoped = decisions_of(d).withColumn("session_id", F.when(F.col("paper_id") % 3 > 0, F.col("paper_id") % 3))
    return filters.count_by_reason(scoped, 1)


@query("a10_summary", CASCADE_SQL + "SELECT count(*) FILTER (WHERE v LIKE 'ACCEPT%') AS accepted, count(*) FILTER (WHERE v LIKE 'QUARANTINE%') AS quarantined, count(*) FILTER (WHERE v LIKE 'REJECT%') AS rejected FROM judged")
def summary(d):
    o = F.col("verdict.outcome")
    return filters.cascade(titled(d), PROXY, AS_OF_YEAR).agg(*[F.count_if(o == v).alias(n) for v, n in (("ACCEPT", "accepted"), ("QUARANTINE", "quarantined"), ("REJECT", "rejected"))])


@query("k04_review", CASCADE_SQL + "SELECT paper_id, title, split_part(v, '|', 3) AS reason, count(*) OVER () AS total, count(*) OVER () > 100 AS truncated FROM judged WHERE v LIKE 'REJECT%' ORDER BY paper_id DESC LIMIT 100")
def review(d):
    rows = filters.review(decisions_of(d).withColumn("id", F.col("paper_id")), titled(d), 1, "REJECT", 100)
    return rows.select("paper_id", "title", "reason", "total", "truncated")


@query("k04_review_counts", CASCADE_SQL + "SELECT split_part(v, '|', 3) AS reason, count(*) AS n FROM judged WHERE v LIKE 'QUARANTINE%' GROUP BY 1")
def review_counts(d):
    return filters.review_counts(decisions_of(d), 1, "QUARANTINE")


#: Fields of a document for the gates: none, a known one or one of neither list, by its language.
FIELDS = "CASE lang WHEN 'en' THEN {a}'Computer Science', 'History'{b} WHEN 'de' THEN {a}'History'{b} WHEN 'fr' THEN {a}'Alchemy'{b} ELSE NULL END"


@query("f14_broad_gate", "SELECT doc_id, lang IS DISTINCT FROM 'de' AS relevant FROM documents")
def broad_gate(d):
    return d.documents.select("doc_id", filters.broad_gate(F.expr(FIELDS.format(a="array(", b=")"))).alias("relevant"))


@query("f15_strict_gate", """WITH t AS (SELECT doc_id, lang, source, lower(left(text, 40) || ' ' || source || ' ' || text) AS x FROM documents)
SELECT doc_id, lang IS DISTINCT FROM 'de' AND (contains(x, 'the') OR contains(x, 'learning') OR contains(lower(source), 'src1'))
  AND NOT (contains(x, 'idiot') OR contains(x, 'src2')) AS core,
  CAST(contains(x, 'the') AS INT) + CAST(contains(x, 'learning') AS INT) AS n_core, CAST(contains(x, 'idiot') AS INT) + CAST(contains(x, 'src2') AS INT) AS n_applied FROM t""")
def strict_gate(d):
    terms = replace(GateTerms(), core=("the", "learning"), venues=("src1",), applied=("idiot", "src2"))
    core, one, other = filters.strict_gate(F.substring("text", 1, 40), F.col("source"), F.col("text"), F.expr(FIELDS.format(a="array(", b=")")), terms)
    return d.documents.select("doc_id", core.alias("core"), F.size(one).alias("n_core"), F.size(other).alias("n_applied"))


@query("x14_sanity", "SELECT paper_id, CASE WHEN paper_id % 13 = 0 THEN 'REJECT|SANITY|RETRACTED' WHEN year IS NULL THEN 'QUARANTINE|SANITY|NO_DATE' ELSE 'ACCEPT|SANITY|OK' END AS verdict FROM px_papers")
def sanity(d):
    return d.px_papers.select("paper_id", told(filters.sanity(F.col("title"), F.col("year"), F.col("paper_id") % 13 == 0)).alias("verdict"))


# Event log ------------------------------------------------------------------------------------


@query("w01_latest_event", "SELECT session_id, paper_id, max(id) AS id, arg_max(event_type, id) AS event_type, arg_max(actor, id) AS actor FROM px_events GROUP BY session_id, paper_id")
def latest_event(d):
    return events.latest(d.px_events).select("session_id", "paper_id", "id", "event_type", "actor")


@query("w02_tombstones", "SELECT session_id, paper_id FROM px_events GROUP BY session_id, paper_id HAVING arg_max(event_type, id) IN ('REMOVED', 'GC_SWEPT')")
def tombstones(d):
    return events.tombstones(d.px_events)


@query("w03_user_held", "SELECT session_id, paper_id FROM px_events GROUP BY session_id, paper_id HAVING arg_max(actor, id) = 'USER'")
def user_held(d):
    return events.user_held(d.px_events)


@query("w05_replay", f"WITH {REPLAY} SELECT session_id, paper_id, state FROM px_nodes")
def replay(d):
    return events.replay(d.px_events)


@query("w06_depth_at_removal", "SELECT session_id, paper_id, coalesce(arg_max(depth, id) FILTER (WHERE event_type IN ('REMOVED', 'GC_SWEPT')), 1) AS depth FROM px_events GROUP BY session_id, paper_id")
def removal_depth(d):
    return events.depth_at_removal(d.px_events)


@query("t01_append_event", """SELECT id, session_id, paper_id, event_type FROM px_events UNION ALL
SELECT (SELECT max(id) FROM px_events) + row_number() OVER (ORDER BY citation_count DESC, paper_id), 1, paper_id, 'LIKED' FROM px_papers""")
def append_event(d):
    log = d.px_events.select("id", "session_id", "paper_id", "event_type")
    fresh = d.px_papers.select(F.struct(-F.col("citation_count"), "paper_id").alias("seq"), F.lit(1).cast("long").alias("session_id"), "paper_id", F.lit("LIKED").alias("event_type"))
    return events.append(log, fresh)


@query("t01_get_events", "SELECT id, event_type, actor FROM px_events WHERE session_id = 1 AND paper_id = 3")
def get_events(d):
    return events.events_of(d.px_events, 1, 3).select("id", "event_type", "actor")


@query("t02_transitions", """SELECT a.s AS from_state, b.s AS to_state, a.s <> b.s AND a.s <> 'SEED' AND b.s <> 'SEED' AS changes, a.s = 'LIKED' AND b.s NOT IN ('LIKED', 'SEED') AS sweep,
CASE WHEN a.s = b.s THEN NULL WHEN a.s = 'SEED' THEN 'SEED_NOT_LABELABLE' WHEN b.s = 'SEED' THEN 'CANNOT_PROMOTE_TO_SEED' END AS error
FROM (VALUES ('SEED'), ('CANDIDATE'), ('LIKED'), ('DISLIKED')) a(s), (VALUES ('SEED'), ('CANDIDATE'), ('LIKED'), ('DISLIKED')) b(s)""")
def transitions(d):
    return events.transitions(d.spark).select("from_state", "to_state", "changes", "sweep", "error")


@query("t03_apply_label", f"""WITH {REPLAY} SELECT session_id, paper_id, state AS from_state, state NOT IN ('SEED', 'LIKED') AS changes,
CASE WHEN state = 'SEED' THEN 'SEED_NOT_LABELABLE' END AS error FROM px_nodes""")
def apply_label(d):
    n = events.replay(d.px_events)
    return events.apply_labels(n, n.select("session_id", "paper_id", F.lit("LIKED").alias("to_state"))).select("session_id", "paper_id", "from_state", "changes", "error")


@query("t04_remove_preview", f"""WITH RECURSIVE {REPLAY}, n AS (SELECT paper_id, state FROM px_nodes WHERE session_id = 1 AND paper_id <> 1),
e AS (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges),
walk AS (SELECT paper_id, 0 AS k FROM n WHERE state IN ('SEED', 'LIKED') UNION
  SELECT e.b, w.k + 1 FROM walk w JOIN e ON e.a = w.paper_id JOIN n ON n.paper_id = e.b WHERE w.k < 3)
SELECT count(*) AS would_go FROM n WHERE state = 'CANDIDATE' AND paper_id NOT IN (SELECT paper_id FROM walk)""")
def remove_preview(d):
    n = nodes_of(d, 1).where("paper_id <> 1")
    return graph.sweep(n, d.px_edges, n.limit(0), 3).agg(F.count("*").alias("would_go"))


@query("t05_drift", f"WITH {REPLAY} SELECT session_id, paper_id, 'CANDIDATE' AS state, state AS replayed FROM px_nodes WHERE state <> 'CANDIDATE'")
def drift(d):
    stored = events.replay(d.px_events).withColumn("state", F.lit("CANDIDATE"))
    return events.drift(d.px_events, stored)


@query("t08_clear", f"WITH {REPLAY} SELECT session_id, count(*) AS n FROM px_nodes WHERE session_id <> 1 GROUP BY session_id")
def clear(d):
    left, _ = events.clear(events.replay(d.px_events), 1)
    return left.groupBy("session_id").agg(F.count("*").alias("n"))


RUNS = """runs AS (SELECT o_orderkey AS id, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'RUNNING' ELSE 'QUEUED' END AS status,
CASE WHEN o_orderkey % 5 = 0 THEN 'note' END AS error, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS BIGINT) END AS n_filtered,
CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 70 AS BIGINT) END AS n_pool, CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey % 50 AS BIGINT) END AS n_added FROM orders)"""


def runs_of(d: Data) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    none, some = F.lit(None).cast("string"), lambda by, of: F.when(k % by == 0, k % of)
    return d.orders.select(
        k.alias("id"), F.col("o_custkey").alias("session_id"), F.when(status == "F", "DONE").when(status == "O", "RUNNING").otherwise("QUEUED").alias("status"),
        F.lit("{}").alias("params"), F.lit("v1").alias("config_version"), none.alias("started_at"), none.alias("finished_at"), F.when(k % 5 == 0, "note").alias("error"),
        some(4, 70).alias("n_pool"), some(2, 90).alias("n_filtered"), some(8, 50).alias("n_added"), F.lit(None).cast("long").alias("api_calls"), F.lit(None).cast("long").alias("cache_hits"),
    )


@query("t09_stage_of", f"WITH {RUNS} SELECT id, CASE WHEN status <> 'RUNNING' THEN status WHEN n_filtered IS NULL THEN 'FETCHING' WHEN n_pool IS NULL THEN 'POOLING' WHEN n_added IS NULL THEN 'RANKING' ELSE 'ADDING' END AS stage FROM runs")
def stage(d):
    return runs_of(d).select("id", runs.stage_of(*[F.col(c) for c in ("status", "n_filtered", "n_pool", "n_added")]).alias("stage"))


@query("t09_enqueue_claim", f"""WITH {RUNS}, q AS (SELECT id, status FROM runs UNION ALL SELECT (SELECT max(id) FROM runs) + row_number() OVER (ORDER BY c_custkey), 'QUEUED' FROM customer)
SELECT id, CASE WHEN id = (SELECT min(id) FROM q WHERE status = 'QUEUED') THEN 'RUNNING' ELSE status END AS status FROM q""")
def enqueue_claim(d):
    asked = d.customer.select(F.col("c_custkey").alias("session_id"), F.lit("{}").alias("params"), F.lit("v1").alias("config_version"), F.col("c_custkey").alias("seq"))
    return runs.claim_next(runs.enqueue(runs_of(d), asked), "2001-01-01").select("id", "status")


@query("t09_progress_finish", f"""WITH {RUNS} SELECT id, CASE WHEN id % 3 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 7 ELSE n_pool END AS n_pool,
CASE WHEN id % 3 = 1 THEN 9 ELSE n_added END AS n_added, CASE WHEN id % 3 = 0 THEN 'late' ELSE error END AS error FROM runs""")
def progress_finish(d):
    own = runs_of(d)
    third = lambda k: own.where(F.col("id") % 3 == k).select("id", "session_id")
    told = runs.record_progress(own, third(1).withColumns({"n_added": F.lit(9).cast("long"), "n_pool": F.lit(None).cast("long")}))
    ended = runs.finish(told, third(0).withColumns({"status": F.lit("FAILED"), "n_pool": F.lit(7).cast("long"), "error": F.lit("late")}), "2001-01-01")
    return ended.select("id", "status", "n_pool", "n_added", "error")


@query("t09_cancel", f"WITH {RUNS} SELECT id, CASE WHEN id % 2 = 0 AND status <> 'DONE' THEN 'CANCELLED' ELSE status END AS status, CASE WHEN id % 2 = 0 AND status <> 'DONE' THEN status END AS previous FROM runs")
def cancel_runs(d):
    own = runs_of(d)
    left, met = runs.cancel(own, own.where(F.col("id") % 2 == 0).select("id", "session_id"), "2001-01-01")
    return left.select("id", "status").join(met.select("id", "previous"), "id", "left")


@query("t09_abandon_active_latest", f"""WITH {RUNS}, a AS (SELECT id, session_id, CASE WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS status,
CASE WHEN status = 'RUNNING' THEN coalesce(error, 'interrupted: the engine stopped while this was running') ELSE error END AS error FROM runs)
SELECT l.session_id, max(l.id) AS latest_id, arg_max(l.status, l.id) AS status, arg_max(coalesce(l.error, '-'), l.id) AS error, min(l.id) FILTER (WHERE l.status = 'QUEUED') AS active_id FROM a l GROUP BY l.session_id""")
def abandon_runs(d):
    left = runs.abandon_running(runs_of(d), "2001-01-01")
    last = runs.latest(left).select("session_id", F.col("id").alias("latest_id"), "status", F.coalesce("error", F.lit("-")).alias("error"))
    return last.join(runs.active(left).select("session_id", F.col("id").alias("active_id")), "session_id", "left")


@query("a01_count_by_state", f"WITH {REPLAY} SELECT session_id, state, count(*) AS n FROM px_nodes GROUP BY session_id, state")
def count_by_state(d):
    return events.replay(d.px_events).groupBy("session_id", "state").agg(F.count("*").alias("n"))


@query("a02_nodes_by_state", f"WITH {REPLAY} SELECT state, array_to_string(list_sort(list(DISTINCT paper_id)), ',') AS papers FROM px_nodes WHERE session_id = 1 GROUP BY state")
def nodes_by_state(d):
    ids = F.array_sort(F.collect_set("paper_id"))
    return nodes_of(d, 1).groupBy("state").agg(F.concat_ws(",", F.transform(ids, lambda x: x.cast("string"))).alias("papers"))


@query("a04_by_state_zeros", f"WITH {REPLAY} SELECT s.s AS state, (SELECT count(*) FROM px_nodes n WHERE n.session_id = 1 AND n.state = s.s) AS n FROM (VALUES ('SEED'), ('CANDIDATE'), ('LIKED'), ('DISLIKED')) s(s)")
def by_state_zeros(d):
    known = d.spark.createDataFrame([(s,) for s in events.STATES], "state string")
    own = nodes_of(d, 1).groupBy("state").agg(F.count("*").alias("n"))
    return known.join(own, "state", "full_outer").na.fill(0, ["n"])


@query("a05_sessions", f"WITH {REPLAY} SELECT s.s AS session_id, (SELECT count(*) FROM px_nodes n WHERE n.session_id = s.s) AS node_count FROM (VALUES (0), (1), (2), (3)) s(s)")
def sessions(d):
    own = events.replay(d.px_events).groupBy("session_id").agg(F.count("*").alias("node_count"))
    return d.spark.range(4).select(F.col("id").alias("session_id")).join(own, "session_id", "left").na.fill(0, ["node_count"])


@query("a11_counts", f"WITH {REPLAY} SELECT (SELECT count(*) FROM px_papers) AS papers, (SELECT count(*) FROM px_edges) AS edges, (SELECT count(*) FROM px_nodes) AS nodes")
def counts(d):
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(d.px_papers, "papers").join(one(d.px_edges, "edges")).join(one(events.replay(d.px_events), "nodes"))


# Lookups and joins ----------------------------------------------------------------------------


@query("p01_nodes_in_states", f"WITH {REPLAY} SELECT paper_id, state FROM px_nodes WHERE session_id = 1 AND state IN ('SEED', 'LIKED')")
def nodes_in_states(d):
    return nodes_of(d, 1).where(F.col("state").isin("SEED", "LIKED")).select("paper_id", "state").orderBy("paper_id")


@query("p05_papers_by_ids", "SELECT r.pos, p.paper_id, p.title FROM (SELECT unnest(range(5)) AS pos, unnest([7, 3, 99999999, 5, 1]) AS paper_id) r JOIN px_papers p ON p.paper_id = r.paper_id")
def papers_by_ids(d):
    asked = d.spark.createDataFrame(list(enumerate([7, 3, 99999999, 5, 1])), "pos long, paper_id long")
    return asked.join(d.px_papers.select("paper_id", "title"), "paper_id").select("pos", "paper_id", "title").orderBy("pos")


@query("p06_visible", "SELECT paper_id, crawl_state <> 'STUB' OR citation_count / 100.0 >= 0.3 AS shown FROM px_papers")
def visible(d):
    state = F.when(F.col("crawl_state") == "STUB", "CANDIDATE").otherwise("LIKED")
    return d.px_papers.select("paper_id", legacy.visible_at(state, F.col("citation_count") / 100.0, 0.3).alias("shown"))


@query("p09_query_match", "SELECT paper_id, contains(lower(title), 're') AS found FROM px_papers")
def query_match(d):
    return d.px_papers.select("paper_id", legacy.matches(F.col("title"), "RE").alias("found"))


#: The order tables hold no preprint categories; one stands for each of their own, and a few titles get a word of the view's terms.
VIEWED = """SELECT paper_id,
  CASE category WHEN 'LARGE' THEN 'q-bio.BM' WHEN 'MEDIUM' THEN 'cond-mat.soft' WHEN 'SMALL' THEN 'physics.chem-ph' WHEN 'STANDARD' THEN 'cs.LG' WHEN 'PROMO' THEN 'math.OC' WHEN 'ECONOMY' THEN NULL END AS category,
  concat(title, CASE CAST(paper_id % 11 AS INT) WHEN 0 THEN ' of Enzymatic reaction' WHEN 1 THEN ' Synthesis' WHEN 2 THEN ' PROTEINS' WHEN 3 THEN ' of molecules' ELSE '' END) AS title
FROM px_papers"""


@query("p10_topic_group", f"""SELECT paper_id, CASE
  WHEN category LIKE 'q-bio.%' OR contains(lower(title), 'enzym') OR contains(lower(title), 'protein') THEN 'biochem'
  WHEN category LIKE 'cond-mat.%' OR category LIKE 'physics.%' OR contains(lower(title), 'synthesis') OR contains(lower(title), 'molecul') THEN 'chem'
  WHEN category LIKE 'cs.%' OR category LIKE 'math.%' THEN 'cs' ELSE 'other' END AS topic FROM ({VIEWED})""")
def topic_group(d):
    papers = d.spark.sql(VIEWED.replace("px_papers", "{p}"), p=d.px_papers)
    return papers.select("paper_id", filters.topic_group(F.col("title"), F.col("category")).alias("topic"))


@query("p12_title_search", "SELECT paper_id, title FROM px_papers WHERE title ILIKE '%A%' ORDER BY paper_id LIMIT 50")
def title_search(d):
    return d.px_papers.where(F.col("title").ilike("%A%")).select("paper_id", "title").orderBy("paper_id").limit(50)


@query("j01_category_coverage", "SELECT round(count(c.category) / CAST(count(p.paper_id) AS DOUBLE), 6) AS coverage FROM px_papers p LEFT JOIN (SELECT DISTINCT paper_id, category FROM px_papers WHERE paper_id % 3 <> 0) c ON c.paper_id = p.paper_id")
def coverage(d):
    meta = d.px_papers.where("paper_id % 3 <> 0").select("paper_id", "category")
    joined = d.px_papers.select("paper_id").join(meta, "paper_id", "left")
    return joined.agg(F.round(F.coalesce(F.count("category") / F.count("paper_id"), F.lit(0.0)), 6).alias("coverage"))


def foreign(d: Data) -> DataFrame:
    """Papers of which a third have titles that are not Latin."""
    return d.px_papers.withColumn("title", F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit("Граф "), "title")).otherwise(F.col("title")))


@query("j08_title_matches", "WITH t AS (SELECT paper_id, year, CASE WHEN paper_id % 3 = 0 THEN 'граф ' ELSE '' END || lower(title) AS t FROM px_papers) SELECT p.paper_id AS probe_id, min(q.paper_id) AS paper_id FROM t p JOIN t q ON q.t = p.t AND (q.year IS NULL OR p.year IS NULL OR q.year = p.year) GROUP BY p.paper_id")
def title_matches(d):
    p = foreign(d).withColumn("author", F.lit("Ada Lovelace"))
    return corpus.title_matches(p.withColumnRenamed("paper_id", "probe_id"), p)


@query("j11_search_flags", f"WITH {REPLAY}, gone AS (SELECT paper_id FROM last_known WHERE session_id = 1 AND event_type IN ('REMOVED', 'GC_SWEPT')) SELECT p.paper_id, p.paper_id IN (SELECT paper_id FROM px_nodes WHERE session_id = 1) AS in_graph, p.paper_id IN (SELECT paper_id FROM gone) AS removed FROM px_papers p")
def search_flags(d):
    n = nodes_of(d, 1).select("paper_id", F.lit(True).alias("in_graph"))
    gone = events.tombstones(d.px_events).where("session_id = 1").select("paper_id", F.lit(True).alias("removed"))
    return d.px_papers.select("paper_id").join(n, "paper_id", "left").join(gone, "paper_id", "left").na.fill(False)


@query("j16_review_tombstones", f"WITH {REPLAY} SELECT p.paper_id, p.title, l.event_type FROM last_known l JOIN px_papers p ON p.paper_id = l.paper_id WHERE l.session_id = 1 AND l.event_type IN ('REMOVED', 'GC_SWEPT')")
def review_tombstones(d):
    gone = events.latest(d.px_events).where("session_id = 1").where(F.col("event_type").isin(*events.TOMBSTONE))
    return gone.join(d.px_papers, "paper_id").select("paper_id", "title", "event_type")


@query("j14_export_defaults", "SELECT p.paper_id, p.title, coalesce(m.n, 0) AS in_degree FROM px_papers p LEFT JOIN (SELECT cited_id, count(*) AS n FROM px_edges GROUP BY cited_id) m ON m.cited_id = p.paper_id")
def export_defaults(d):
    m = d.px_edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("in_degree"))
    return d.px_papers.select("paper_id", "title").join(m, "paper_id", "left").na.fill(0, ["in_degree"])


# Merges ---------------------------------------------------------------------------------------


@query("u01_merge_edges", """WITH s AS (SELECT l_orderkey AS a, l_suppkey AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'BACKWARD' ELSE 'FORWARD' END AS via, l_quantity > 40 AS infl, l_returnflag AS i FROM lineitem WHERE l_orderkey <> l_suppkey)
SELECT a AS citing_id, b AS cited_id, CASE WHEN count(DISTINCT via) > 1 THEN 'BOTH' ELSE max(via) END AS discovered_via, bool_or(infl) AS is_influential, array_to_string(list_sort(list(DISTINCT i)), ',') AS intents FROM s GROUP BY a, b""")
def merge_edges(d):
    l = d.lineitem
    s = l.select(F.col("l_orderkey").alias("citing_id"), F.col("l_suppkey").alias("cited_id"), F.when(F.col("l_linenumber") % 2 == 0, "BACKWARD").otherwise("FORWARD").alias("discovered_via"), (F.col("l_quantity") > 40).alias("is_influential"), F.array("l_returnflag").alias("intents"), F.col("l_shipdate").alias("first_seen_at"), F.col("l_shipdate").alias("seq"))
    return corpus.merge_edges(s).select("citing_id", "cited_id", "discovered_via", "is_influential", F.concat_ws(",", "intents").alias("intents"))


@query("u02_merge_papers", """WITH s AS (SELECT o_custkey AS paper_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'METADATA' WHEN 'O' THEN 'STUB' ELSE 'EXPANDED' END AS st,
CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 3 END AS BIGINT) AS r, CAST(floor(o_totalprice) AS BIGINT) AS c, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders)
SELECT paper_id, arg_max(st, r * 1000000000 + seq) AS crawl_state, arg_max(c, r * 1000000000 + seq) AS citation_count, arg_max(v, seq) FILTER (WHERE v IS NOT NULL) AS venue FROM s GROUP BY paper_id""")
def merge_papers(d):
    o, st = d.orders, F.col("o_orderstatus")
    s = o.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("seq"), F.when(st == "F", "METADATA").when(st == "O", "STUB").otherwise("EXPANDED").alias("crawl_state"), F.floor("o_totalprice").alias("citation_count"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("venue"), F.col("o_orderdate").alias("first_seen_at"))
    return corpus.merge_papers(s, ("citation_count",), ("venue",)).select("paper_id", "crawl_state", "citation_count", "venue")


@query("u04_keep_last", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def keep_last(d):
    return corpus.keep_last(d.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@query("u05_merge_nodes", "SELECT session_id, paper_id, arg_max(event_type, id) AS state, arg_max(depth, id) AS depth, arg_max(id % 100, id) FILTER (WHERE id % 2 = 0) AS score FROM px_events GROUP BY session_id, paper_id")
def merge_nodes(d):
    w = d.px_events.select("session_id", "paper_id", F.col("event_type").alias("state"), "depth", F.when(F.col("id") % 2 == 0, F.col("id") % 100).alias("score"), "actor", F.col("id").alias("seq")).withColumnRenamed("actor", "added_by")
    return corpus.merge_nodes(w).drop("added_by")


@query("u08_set_difference", f"WITH {REPLAY} SELECT paper_id FROM px_nodes WHERE session_id = 1 AND paper_id NOT IN (SELECT paper_id FROM px_nodes WHERE session_id = 2)")
def set_difference(d):
    return nodes_of(d, 1).select("paper_id").subtract(nodes_of(d, 2).select("paper_id"))


@query("u10_shorter_distance", "WITH s AS (SELECT o_custkey AS p, CAST(o_orderkey % 4 AS INT) AS k, o_orderpriority AS c FROM orders), m AS (SELECT p, min(k) AS k FROM s GROUP BY p) SELECT s.p AS paper_id, s.k AS distance, array_to_string(list_sort(list(DISTINCT s.c)), ',') AS connections FROM s JOIN m ON m.p = s.p AND m.k = s.k GROUP BY s.p, s.k")
def shorter_distance(d):
    s = d.orders.select(F.col("o_custkey").alias("paper_id"), (F.col("o_orderkey") % 4).cast("int").alias("distance"), F.array("o_orderpriority").alias("connections"))
    return corpus.shorter_distance(s).withColumn("connections", F.concat_ws(",", "connections"))


@query("x_canonical_groups", "SELECT paper_id, min(paper_id) OVER (PARTITION BY CASE WHEN paper_id % 5 = 0 THEN 'd' || (paper_id % 50) WHEN paper_id % 5 = 1 THEN 'a' || (paper_id % 50) ELSE 't' || (paper_id % 3 = 0) || lower(title) || coalesce(CAST(year AS VARCHAR), '-') END) AS canonical_paper_id FROM px_papers")
def canonical_groups(d):
    m = (F.col("paper_id") % 50).cast("string")
    doi = F.when(F.col("paper_id") % 5 == 0, F.concat(F.lit(" 10.1/X"), m))
    arxiv = F.when(F.col("paper_id") % 5 == 1, F.concat(F.lit("2001."), m, F.concat(F.lit("v"), (F.col("paper_id") % 3).cast("string"))))
    keyed = foreign(d).withColumn("key", text.canonical_key(doi, arxiv, F.col("title"), F.lit("Ada Lovelace"), F.col("year")))
    return corpus.duplicate_groups(keyed)


# Text, dates, layout expressions --------------------------------------------------------------


@query("x_normalize_title", "SELECT paper_id, 'cafe ' || trim(regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g')) AS title_norm FROM px_papers")
def titles(d):
    return d.px_papers.select("paper_id", text.normalize_title(F.concat(F.lit("The Café: "), "title")).alias("title_norm"))


@query("x_ascii_title", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS t FROM part")
def ascii_titles(d):
    return d.part.select("p_partkey", text.ascii_title(F.concat(F.lit("The "), "p_name")).alias("t"))


@query("x_strings", "SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9_]', '', 'g')) AS surname, CASE WHEN c_custkey % 2 = 0 THEN '2001.' || c_custkey END AS arxiv, CASE WHEN c_custkey % 4 = 0 THEN 'doi' WHEN c_custkey % 4 = 1 THEN 'openalex' ELSE 'title' END AS kind, 'token=***' AS line FROM customer")
def strings(d):
    k = F.col("c_custkey")
    doi = F.when(k % 2 == 0, F.concat(F.lit("10.48550/arXiv.2001."), k.cast("string"), F.lit("v2")))
    seed = F.when(k % 4 == 0, F.concat(F.lit("10.1234/x"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("W"), k.cast("string"))).otherwise(F.col("c_name"))
    return d.customer.select("c_custkey", text.surname_of(F.concat(F.lit("Ada "), "c_name")).alias("surname"), text.arxiv_id_of(F.lit(None).cast("string"), doi).alias("arxiv"), text.identifier_kind(seed).alias("kind"), text.redact_secrets(F.concat(F.lit("token="), "c_name")).alias("line"))


@query("x_partial_dates", """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN make_date(CAST(year(o_orderdate) AS INT), 1, 1) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS first_day,
CAST(CASE o_orderkey % 4 WHEN 0 THEN make_date(CAST(year(o_orderdate) AS INT), 12, 31) WHEN 1 THEN last_day(o_orderdate) WHEN 2 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS last_day FROM orders""")
def partial_dates(d):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    t = F.when(k == 0, F.substring(day, 1, 4)).when(k == 1, F.substring(day, 1, 7)).when(k == 2, day).otherwise("soon")
    return d.orders.select("o_orderkey", dates.earliest(t).cast("string").alias("first_day"), dates.latest(t).cast("string").alias("last_day"))


@query("r11_legacy_score", "SELECT paper_id, round(0.5 * (1 - exp(-(2 * (paper_id % 3) + paper_id % 5) / 4.0)) + 0.35 * 0.5 + 0.15 * least(1.0, ln(1 + citation_count) / ln(10001)), 6) AS score FROM px_papers")
def legacy_score(d):
    p = F.col("paper_id")
    return d.px_papers.select("paper_id", F.round(scores.legacy_score(p % 3, p % 5, F.lit(0.5), F.col("citation_count")), 6).alias("score"))


@query("r12_cosine", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])))), 6) AS cosine FROM embeddings")
def cosine(d):
    one = d.embeddings.where("vec_id = 0").select(F.col("embedding").alias("probe")).limit(1)
    return d.embeddings.join(F.broadcast(one)).select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("probe")), 6).alias("cosine"))


@query("a16_centroid", "SELECT label, p.i AS pos, round(avg(CAST(embedding[p.i + 1] AS DOUBLE)), 6) AS m FROM embeddings, (SELECT unnest(range(64)) AS i) p GROUP BY label, p.i")
def centroid(d):
    c = legacy.centroid(d.embeddings, "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("m"))


@query("r13_r14_node_scores", "SELECT paper_id, round(0.4 * 0.5 + 0.3 * citation_count / 100.0 + 0.2 * (paper_id % 2) + 0.1 * 0.25, 6) AS hybrid, round((0.5 + citation_count / 100.0 + 0.25) / 3, 6) AS node_score FROM px_papers")
def node_scores(d):
    c = F.col("citation_count") / 100.0
    return d.px_papers.select("paper_id", F.round(scores.mean_hybrid(F.lit(0.5), c, F.col("paper_id") % 2, F.lit(0.25)), 6).alias("hybrid"), F.round(legacy.node_score(F.lit(0.5), c, F.lit(0.25), F.col("year")), 6).alias("node_score"))


@query("r15_venue_score", "SELECT paper_id, CASE WHEN contains(venue, '#1') THEN 1.0 WHEN contains(venue, '#2') THEN 0.7 ELSE 0.3 END AS score FROM px_papers")
def venue_score(d):
    return d.px_papers.select("paper_id", scores.venue_score(F.col("venue"), {1.0: ("Brand#1",), 0.7: ("Brand#2",)}).alias("score"))


@query("r16_boost", "SELECT paper_id, round(CASE WHEN paper_id % 2 = 0 THEN least(citation_count / 50.0 + 0.15, 1.0) ELSE citation_count / 50.0 END, 6) AS score FROM px_papers")
def boost(d):
    return d.px_papers.select("paper_id", F.round(legacy.boosted(F.col("citation_count") / 50.0, F.col("paper_id") % 2 == 0), 6).alias("score"))


@query("r17_radius", "SELECT paper_id, round(2 * greatest(5.0, least(28.0, 4 + 0.35 * sqrt(citation_count))), 6) AS size FROM px_papers")
def radius(d):
    return d.px_papers.select("paper_id", F.round(scores.radius(F.col("citation_count")), 6).alias("size"))


@query("w08_year_shade", "SELECT paper_id, round(CASE WHEN year IS NULL THEN 0.5 ELSE (year - min(year) OVER ()) / CAST(max(year) OVER () - min(year) OVER () AS DOUBLE) END, 6) AS shade FROM px_papers")
def year_shade(d):
    return legacy.year_shade(d.px_papers, "year").select("paper_id", F.round("shade", 6).alias("shade"))


@query("w09_score_bars", f"""WITH t AS (SELECT paper_id, 'hub' AS term, -0.6 * citation_count AS value FROM px_papers UNION ALL SELECT paper_id, 'quality', 0.4 * ({RATE}) FROM px_papers)
SELECT paper_id, term, round(abs(value) / max(abs(value)) OVER (PARTITION BY paper_id), 6) AS width, CASE WHEN value < 0 THEN 'negative' ELSE 'positive' END AS sign,
row_number() OVER (PARTITION BY paper_id ORDER BY abs(value) DESC, term) AS place FROM t""")
def score_bars(d):
    terms = F.create_map(F.lit("hub"), F.lit(-0.6) * F.col("citation_count"), F.lit("quality"), 0.4 * scores.ranked_rate(F.col("citation_count"), F.col("year"), AS_OF_YEAR))
    b = legacy.score_bars(d.px_papers.select("paper_id", terms.alias("terms")), "paper_id", "terms")
    return b.select("paper_id", "term", F.round("width", 6).alias("width"), "sign", F.col("place").cast("long").alias("place"))


@query("w10_wave_share", "SELECT paper_id, round(citation_count / CAST(max(citation_count) OVER (PARTITION BY category) AS DOUBLE), 6) AS share FROM px_papers")
def wave_share(d):
    return legacy.wave_share(d.px_papers, "citation_count", "category", "share").select("paper_id", F.round("share", 6).alias("share"))


@query("a12_ranges", f"WITH {REPLAY} SELECT min(p.year) AS first_year, max(p.year) AS last_year, min(p.citation_count) FILTER (WHERE n.state = 'CANDIDATE') AS least_score, max(p.citation_count) FILTER (WHERE n.state = 'CANDIDATE') AS most_score FROM px_nodes n JOIN px_papers p ON p.paper_id = n.paper_id WHERE n.session_id = 1")
def ranges(d):
    rows = nodes_of(d, 1).join(d.px_papers, "paper_id")
    score = F.when(F.col("state") == "CANDIDATE", F.col("citation_count"))
    return rows.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min(score).alias("least_score"), F.max(score).alias("most_score"))


@query("k05_legacy_ranked", """WITH m AS (SELECT cited_id AS paper_id, count(*) AS co FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors) GROUP BY cited_id)
SELECT p.paper_id, coalesce(m.co, 0) AS co_citation, (p.paper_id % 7) / 10.0 AS pagerank, p.citation_count FROM px_papers p LEFT JOIN m ON m.paper_id = p.paper_id
WHERE p.paper_id % 4 > 1 AND p.paper_id NOT IN (SELECT paper_id FROM px_anchors) ORDER BY co_citation DESC, pagerank DESC, p.citation_count DESC, p.paper_id LIMIT 40""")
def legacy_ranked(d):
    co = legacy.seed_metrics(d.px_edges, d.px_anchors).select("paper_id", F.col("cited_by_seeds").alias("co_citation"))
    made = d.px_papers.select("paper_id", ((F.col("paper_id") % 7) / 10.0).alias("pagerank")).join(co, "paper_id", "left")
    return legacy.ranked_candidates(labelled(d), made, d.px_anchors, 40).select("paper_id", "co_citation", "pagerank", "citation_count")


@query("r11_network_scores", """WITH e AS (SELECT citing_id AS a, cited_id AS b FROM px_edges), s AS (SELECT paper_id FROM px_anchors),
cb AS (SELECT b AS paper_id, count(*) AS n FROM e WHERE a IN (SELECT paper_id FROM s) GROUP BY b), cs AS (SELECT a AS paper_id, count(*) AS n FROM e WHERE b IN (SELECT paper_id FROM s) GROUP BY a),
sh AS (SELECT x.a AS paper_id, count(*) AS n FROM e x JOIN e y ON y.b = x.b WHERE y.a IN (SELECT paper_id FROM s) GROUP BY x.a),
r AS (SELECT p.paper_id, p.citation_count * 20 AS c, (p.paper_id % 10) / 10.0 AS sim, coalesce(cb.n, 0) AS cb, coalesce(cs.n, 0) AS cs, coalesce(sh.n, 0) AS sh FROM px_papers p
LEFT JOIN cb ON cb.paper_id = p.paper_id LEFT JOIN cs ON cs.paper_id = p.paper_id LEFT JOIN sh ON sh.paper_id = p.paper_id WHERE p.paper_id NOT IN (SELECT paper_id FROM s)),
t AS (SELECT paper_id, round(0.5 * (1 - exp(-(2 * (cb + cs) + sh) / 4.0)) + 0.35 * sim + 0.15 * least(1.0, ln(1 + c) / ln(10001)), 6) AS score,
concat_ws('; ', CASE WHEN cb > 0 THEN 'cited by ' || cb || ' of your seed papers' END, CASE WHEN cs > 0 THEN 'cites ' || cs || ' of your seed papers' END, CASE WHEN sh > 0 THEN 'shares ' || sh || ' references with your seed papers' END,
CASE WHEN sim > 0.6 THEN 'high semantic similarity (' || format('{:.2f}', sim) || ')' END, CASE WHEN c > 500 THEN c || ' citations' END) AS said FROM r)
SELECT paper_id, score, CASE WHEN said = '' THEN 'indirect link via citation graph' ELSE said END AS reasons FROM t""")
def network_scores(d):
    rows = d.px_papers.select("paper_id", (F.col("citation_count") * 20).alias("citation_count"), ((F.col("paper_id") % 10) / 10.0).alias("similarity"))
    made = legacy.network_scores(d.px_edges, d.px_anchors, rows)
    return made.select("paper_id", F.round("score", 6).alias("score"), F.concat_ws("; ", "reasons").alias("reasons"))


@query("x14_expansion_value", "SELECT paper_id, round(1.0 / (1 + paper_id % 3) * (CASE WHEN paper_id % 5 = 0 THEN 1.5 ELSE 1.0 END) * (CASE paper_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END) * (0.3 + 0.7 * (paper_id % 11) / 10.0), 6) AS value FROM px_papers")
def expansion_value(d):
    k = F.col("paper_id")
    state = F.when(k % 4 == 0, "EXPANDED").when(k % 4 == 1, "REFS_DONE").otherwise("METADATA")
    return d.px_papers.select("paper_id", F.round(legacy.expansion_value(k % 3, k % 5 == 0, state, (k % 11) / 10.0), 6).alias("value"))


@query("x14_dislike_proximity", """WITH n AS (SELECT citing_id AS p, cited_id AS o FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges)
SELECT p AS paper_id, round(avg(CASE WHEN o IN (SELECT paper_id FROM px_anchors) THEN 1.0 ELSE 0.0 END), 6) AS proximity FROM n GROUP BY p""")
def dislike_proximity(d):
    return legacy.dislike_proximity(d.px_edges, d.px_anchors).select("paper_id", F.round("proximity", 6).alias("proximity"))


@query("x14_group_labels", """WITH w AS (SELECT venue, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) AS word FROM px_papers),
c AS (SELECT venue, word, count(*) AS n FROM w WHERE word <> '' GROUP BY venue, word), h AS (SELECT word, count(*) AS k FROM c GROUP BY word),
r AS (SELECT c.venue, c.word, row_number() OVER (PARTITION BY c.venue ORDER BY c.n * ln((SELECT count(DISTINCT venue) FROM px_papers) / CAST(h.k AS DOUBLE)) DESC, c.word) AS place FROM c JOIN h ON h.word = c.word)
SELECT venue, word, place FROM r WHERE place <= 5""")
def group_labels(d):
    return legacy.group_labels(d.px_papers, "venue", "title", 5).select("venue", "word", F.col("place").cast("long").alias("place"))


@query("x_cell", "SELECT p_partkey, rpad(CASE WHEN p_partkey % 3 = 0 THEN '-' WHEN length(p_name) > 12 THEN substr(p_name, 1, 11) || '…' ELSE p_name END, 12, ' ') AS cell FROM part")
def cells(d):
    return d.part.select("p_partkey", text.cell(F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), 12).alias("cell"))


@query("x14_rocchio", """WITH e AS (SELECT label AS session_id, unnest(range(1, 65)) AS pos, unnest(embedding) AS v, vec_id FROM embeddings),
m AS (SELECT session_id, pos, avg(v) FILTER (WHERE vec_id % 3 = 0) AS l, avg(v) FILTER (WHERE vec_id % 3 = 1) AS n FROM e GROUP BY session_id, pos)
SELECT session_id, round(sum(0.75 * coalesce(l, 0) - 0.15 * coalesce(n, 0)), 4) AS total FROM m GROUP BY session_id""")
def rocchio(d):
    zero = F.transform("embedding", lambda v: F.lit(0.0))
    state = F.when(F.col("vec_id") % 3 == 0, "LIKED").when(F.col("vec_id") % 3 == 1, "DISLIKED").otherwise("CANDIDATE")
    rows = d.embeddings.select(F.col("label").alias("session_id"), state.alias("state"), F.col("embedding").alias("vector"), zero.alias("query"))
    total = F.aggregate("query", F.lit(0.0), lambda s, v: s + v)
    return legacy.nudged(rows, "query").select("session_id", F.round(total, 4).alias("total"))


# Sources --------------------------------------------------------------------------------------


@query("s01_snapshot", "SELECT 'id' || p_partkey AS arxiv_id, p_type AS primary_category, 2 AS n_categories, '2020-01-01' AS updated FROM part WHERE p_partkey % 10 <> 0")
def snapshot(d):
    k = F.col("p_partkey")
    good = F.to_json(F.struct(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.concat("p_type", F.lit("  cs.X")).alias("categories"), F.lit("2020-01-01").alias("update_date")))
    lines = d.part.select(F.when(k % 10 == 0, F.lit('{"id": broken')).otherwise(good).alias("value"))
    return metadata.snapshot(lines).select("arxiv_id", "primary_category", F.size("categories").alias("n_categories"), "updated")


@query("s03_harvest", "SELECT 'id' || p_partkey AS arxiv_id, p_type AS primary_category, CASE WHEN p_partkey % 2 = 0 THEN '2021' ELSE '2020' END AS updated FROM part WHERE p_partkey % 10 <> 0")
def harvest(d):
    k = F.col("p_partkey")
    cats = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat("p_type", F.lit(" cs.X")))
    updated = F.when(k % 2 == 0, F.lit("<updated>2021</updated>")).otherwise("")
    xml = F.concat(F.lit("<arXiv><id>id"), k.cast("string"), F.lit("</id><categories>"), cats, F.lit("</categories><created>2020</created>"), updated, F.lit("</arXiv>"))
    return metadata.harvest(d.part.select(xml.alias("value"))).select("arxiv_id", "primary_category", "updated")


@query("s05_latest_metadata", "SELECT o_custkey AS arxiv_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def latest_metadata(d):
    return metadata.latest_metadata(d.orders.select(F.col("o_custkey").alias("arxiv_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq")))


@query("s06_lookup", "SELECT paper_id, category FROM px_papers WHERE paper_id IN (SELECT paper_id FROM px_anchors)")
def lookup(d):
    return d.px_papers.join(d.px_anchors, "paper_id", "left_semi").select("paper_id", "category")


@query("s07_category_counts", "SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, category LIMIT 10")
def category_counts(d):
    return d.part.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("s09_s10_papers", "SELECT 's' || p_partkey AS s2_paper_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS citation_count, 1 AS n_authors FROM part WHERE p_partkey % 10 <> 0")
def api_papers(d):
    k = F.col("p_partkey")
    authors = F.array(F.struct(F.lit("1").alias("authorId"), F.lit("Ada").alias("name")), F.struct(F.lit(None).cast("string").alias("authorId"), F.lit("Bob").alias("name")))
    value = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("paperId"), F.when(k % 10 != 0, F.col("p_name")).alias("title"), F.when(k % 3 != 0, F.col("p_size")).alias("citationCount"), authors.alias("authors")))
    return metadata.papers(d.part.select(value.alias("value"))).select("s2_paper_id", "title", "citation_count", F.size("authors").alias("n_authors"))


@query("s11_neighbour_edges", "SELECT 'c' || l_orderkey AS citing, 'p' || l_partkey AS cited, count(*) AS n FROM lineitem GROUP BY 1, 2")
def neighbour_edges(d):
    item = F.struct(F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("paperId")).alias("citedPaper"), F.lit(True).alias("isInfluential"))
    me = F.struct(F.struct(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("paperId")).alias("citedPaper"), F.lit(False).alias("isInfluential"))
    pages = d.lineitem.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("center"), F.lit("BACKWARD").alias("direction"), F.to_json(F.struct(F.array(item, me).alias("data"))).alias("value"))
    return metadata.neighbour_edges(pages).groupBy("citing", "cited").agg(F.count("*").alias("n"))


@query("s12_cache_key", "SELECT c_custkey, sha256('/paper' || chr(0) || '{\"a\":\"' || c_custkey || '\",\"b\":\"x\"}') AS key FROM customer")
def cache_key(d):
    return d.customer.select("c_custkey", metadata.cache_key(F.lit("/paper"), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("c_custkey").cast("string"))).alias("key"))


@query("s16_inverted_abstract", "SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_brand AS abstract FROM part")
def inverted(d):
    index = F.create_map(F.col("p_brand"), F.array(F.lit(0), F.lit(2)), F.col("p_type"), F.array(F.lit(1)))
    return d.part.select("p_partkey", metadata.inverted_abstract(index).alias("abstract"))


@query("s19_reading_list", "SELECT min(p_partkey) AS pos, lower(p_type) AS title FROM part WHERE p_partkey % 5 <> 0 GROUP BY lower(p_type)")
def reading_list(d):
    k = F.col("p_partkey")
    lines = d.part.select(k.alias("pos"), F.when(k % 5 == 0, F.lit("# note")).when(k % 2 == 0, F.lower("p_type")).otherwise(F.concat(F.lit("  "), "p_type")).alias("value"))
    return metadata.reading_list(lines).select("pos", F.lower("title").alias("title"))


# Evaluation -----------------------------------------------------------------------------------

RANKED = """cand AS (SELECT citing_id AS case_id, cited_id AS paper_id FROM px_edges UNION SELECT p.paper_id % 50, p.paper_id FROM px_papers p),
ranked AS (SELECT c.case_id, c.paper_id, row_number() OVER (PARTITION BY c.case_id ORDER BY p.citation_count DESC, c.paper_id) AS rank FROM cand c JOIN px_papers p ON p.paper_id = c.paper_id),
truth AS (SELECT citing_id AS case_id, cited_id AS paper_id FROM px_edges)"""


def candidates_of(d: Data) -> DataFrame:
    e = d.px_edges.select(F.col("citing_id").alias("case_id"), F.col("cited_id").alias("paper_id"))
    more = d.px_papers.select((F.col("paper_id") % 50).alias("case_id"), "paper_id")
    # one shuffle by paper serves the grouping and the join
    return e.union(more).repartition("paper_id").distinct().join(d.px_papers.select("paper_id", "citation_count", "year"), "paper_id")


#: Every second place repeats an earlier paper.
REPEATED = RANKED + """, twice AS (SELECT case_id, paper_id, 2 * rank - 1 AS rank FROM ranked UNION ALL
SELECT a.case_id, a.paper_id, 2 * b.rank FROM ranked b JOIN ranked a ON a.case_id = b.case_id AND a.rank = (b.rank + 1) // 2)"""


def repeated(d: Data) -> DataFrame:
    """The paper at ``rank`` stands at 2 * rank - 1 and, as far as its case has so many papers, at twice the places 2 * rank - 1 and 2 * rank."""
    ranked = evaluation.baseline(candidates_of(d), "citation_count", "_n")
    at = 2 * F.col("rank")
    again = F.filter(F.array(at - 1, at), lambda b: b <= F.col("_n"))
    places = F.concat(F.array(at - 1), F.transform(again, lambda b: 2 * b))
    return ranked.select("case_id", "paper_id", F.explode(places).alias("rank"))


def truth_of(d: Data) -> DataFrame:
    return d.px_edges.select(F.col("citing_id").alias("case_id"), F.col("cited_id").alias("paper_id"))


METRICS = """n AS (SELECT case_id, count(*) AS n FROM truth GROUP BY case_id),
u AS (SELECT case_id, paper_id, row_number() OVER (PARTITION BY case_id ORDER BY min(rank)) AS place FROM twice WHERE rank <= 20 GROUP BY case_id, paper_id),
h AS (SELECT u.case_id, count(*) AS f, sum(1 / log2(place + 1)) AS dcg FROM u JOIN truth t ON t.case_id = u.case_id AND t.paper_id = u.paper_id GROUP BY u.case_id),
g AS (SELECT r.case_id, min(rank) AS b FROM twice r JOIN truth t ON t.case_id = r.case_id AND t.paper_id = r.paper_id GROUP BY r.case_id),
m AS (SELECT n.case_id, coalesce(f, 0) / CAST(n AS DOUBLE) AS recall, CAST(coalesce(f, 0) > 0 AS INT) AS hit, coalesce(1.0 / b, 0) AS rr,
coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 21)) AS i) WHERE i <= n.n) AS ndcg FROM n LEFT JOIN h ON h.case_id = n.case_id LEFT JOIN g ON g.case_id = n.case_id)"""


@query("e01_e04_metrics", f"WITH {REPEATED}, {METRICS} SELECT case_id, hit, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m")
def metrics(d):
    m = evaluation.metrics(repeated(d), truth_of(d), 20)
    return m.select("case_id", "hit", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


@query("e05_bootstrap")
def bootstrap(d):
    scored = d.px_papers.select("category", "paper_id", (F.col("citation_count") / 50.0).alias("v"))
    return evaluation.bootstrap(scored, "category", "v", "paper_id")


@query("e06_baseline_citations", f"WITH {RANKED} SELECT case_id, paper_id, rank FROM ranked")
def citation_baseline(d):
    return evaluation.baseline(candidates_of(d), "citation_count").withColumn("rank", F.col("rank").cast("long"))


@query("e06_baseline_random")
def random_baseline(d):
    return evaluation.random_baseline(candidates_of(d))


@query("e07_cutoff", f"WITH {RANKED} SELECT c.case_id, c.paper_id FROM cand c JOIN px_papers p ON p.paper_id = c.paper_id WHERE p.year IS NOT NULL AND p.year <= 1996")
def cutoff(d):
    rows = candidates_of(d).withColumn("date", F.col("year").cast("string")).withColumn("cutoff", F.to_date(F.lit("1996-12-31")))
    return evaluation.enforce_cutoff(rows, "date", "cutoff").select("case_id", "paper_id")


@query("a09_e09_eligible", "SELECT p.paper_id, r.n AS n_refs, p.year FROM px_papers p JOIN (SELECT citing_id, count(DISTINCT cited_id) AS n FROM px_edges GROUP BY citing_id) r ON r.citing_id = p.paper_id WHERE r.n >= 15 AND p.year BETWEEN 1995 AND 2000 ORDER BY p.paper_id LIMIT 300")
def eligible(d):
    return evaluation.eligible_targets(d.px_edges, d.px_papers, 1995, 2000, 15, 300)


@query("e08_make_cases")
def cases(d):
    targets = evaluation.eligible_targets(d.px_edges, d.px_papers, 1995, 2000, 15, None)
    return evaluation.make_cases(targets, evaluation.dated_references(d.px_edges, dated(d)))


def dated(d: Data) -> DataFrame:
    return d.px_papers.withColumn("publication_date", F.when(F.col("paper_id") % 2 == 0, "1999-05"))


@query("e06_baseline_per_year", f"WITH {RANKED} SELECT c.case_id, c.paper_id, row_number() OVER (PARTITION BY c.case_id ORDER BY {RATE} DESC, c.paper_id) AS rank FROM cand c JOIN px_papers p ON p.paper_id = c.paper_id")
def per_year_baseline(d):
    rows = candidates_of(d).withColumn("as_of", F.lit(AS_OF_YEAR))
    return evaluation.per_year_baseline(rows, "as_of").withColumn("rank", F.col("rank").cast("long"))


@query("e06_baseline_overlap", f"WITH {POOL} SELECT 1 AS case_id, paper_id, row_number() OVER (ORDER BY anchor_overlap DESC, paper_id) AS rank FROM pool")
def overlap_baseline(d):
    rows = pool_of(d).withColumn("case_id", F.lit(1))
    return evaluation.baseline(rows, "anchor_overlap").withColumn("rank", F.col("rank").cast("long"))


@query("e06_baseline_bfs", """WITH RECURSIVE e AS (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges),
walk AS (SELECT paper_id, 0 AS k FROM px_anchors UNION SELECT e.b, w.k + 1 FROM walk w JOIN e ON e.a = w.paper_id WHERE w.k < 2),
near AS (SELECT paper_id, min(k) AS k FROM walk GROUP BY paper_id) SELECT 1 AS case_id, paper_id, row_number() OVER (ORDER BY k, paper_id) AS rank FROM near WHERE k > 0""")
def bfs_baseline(d):
    rows = graph.reach(d.px_edges, d.px_anchors, 2).where("distance > 0").select(F.lit(1).alias("case_id"), "paper_id", F.col("distance").alias("level"))
    return evaluation.bfs_baseline(rows).withColumn("rank", F.col("rank").cast("long"))


@query("e10_evaluate", f"WITH {REPEATED}, {METRICS} SELECT 'citations' AS run, x.metric, round(avg(x.v), 6) AS mean FROM (SELECT unnest(['recall', 'hit', 'rr', 'ndcg']) AS metric, unnest([recall, hit, rr, ndcg]) AS v FROM m) x GROUP BY x.metric")
def evaluate(d):
    d.px_edges, drop = written(d.px_edges)  # candidates and truth
    run = repeated(d).withColumn("run", F.lit("citations"))
    found = cut(evaluation.evaluate(run, truth_of(d), 20, ["citations"]))
    drop()
    return found.select("run", "metric", F.round("mean", 6).alias("mean"))


@query("j15_references", "SELECT e.citing_id AS case_id, e.cited_id AS paper_id, CASE WHEN p.paper_id % 2 = 0 THEN '1999-05' ELSE CAST(p.year AS VARCHAR) END AS date FROM px_edges e JOIN px_papers p ON p.paper_id = e.cited_id")
def references(d):
    rows = evaluation.dated_references(d.px_edges, dated(d))
    return rows.select(F.col("citing_id").alias("case_id"), F.col("cited_id").alias("paper_id"), "date")


@query("x14_fuse", "SELECT paper_id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM (SELECT paper_id, row_number() OVER (ORDER BY citation_count DESC, paper_id) AS rank FROM px_papers UNION ALL SELECT paper_id, row_number() OVER (ORDER BY year DESC NULLS LAST, paper_id) FROM px_papers) GROUP BY paper_id")
def fuse(d):
    p = d.px_papers.withColumn("case_id", F.lit(0))
    both = evaluation.baseline(p, "citation_count").unionByName(evaluation.baseline(p, "year"))
    return evaluation.fuse(both).select("paper_id", F.round("fused", 9).alias("fused"))


@query("t_streaming_activity", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def activity(d):
    from biblioloom.streaming.replay import activity_stream

    return activity_stream(d.events).select(F.col("window.start").alias("hour"), "event_type", "n")


# Further lookups, views and ingestion -----------------------------------------------------------


@query("p02_nodes_present", f"WITH {REPLAY} SELECT paper_id FROM px_nodes WHERE session_id = 1 AND paper_id IN (SELECT paper_id FROM px_anchors)")
def nodes_present(d):
    return nodes_of(d, 1).join(d.px_anchors, "paper_id", "left_semi").select("paper_id")


@query("p04_find_by_key", "SELECT paper_id, title FROM px_papers WHERE title IN (SELECT title FROM px_papers WHERE paper_id IN (5, 17))")
def find_by_key(d):
    keys = d.px_papers.where("paper_id IN (5, 17)").select("title").distinct()
    return d.px_papers.join(keys, "title", "left_semi").select("paper_id", "title")


@query("p07_navigable", "SELECT paper_id FROM px_papers WHERE crawl_state <> 'STUB' OR citation_count / 100.0 >= 0.3")
def navigable(d):
    state = F.when(F.col("crawl_state") == "STUB", "CANDIDATE").otherwise("LIKED")
    return d.px_papers.where(legacy.visible_at(state, F.col("citation_count") / 100.0, 0.3)).select("paper_id").orderBy("paper_id")


@query("p08_clamp", "SELECT paper_id, least(greatest(citation_count, 20), 40) AS clamped FROM px_papers")
def clamp(d):
    return d.px_papers.select("paper_id", F.least(F.greatest("citation_count", F.lit(20)), F.lit(40)).alias("clamped"))


@query("p11_label_flags", "SELECT paper_id, crawl_state <> 'STUB' OR coalesce(citation_count / 100.0, 0) >= 0.35 AS relevant, TRUE AS everything, FALSE AS hidden FROM px_papers")
def label_flags(d):
    state = F.when(F.col("crawl_state") == "STUB", "CANDIDATE").otherwise("SEED")
    shown = lambda mode: legacy.label_shown(state, F.col("citation_count") / 100.0, mode)
    return d.px_papers.select("paper_id", shown("relevant").alias("relevant"), shown("all").alias("everything"), shown("hidden").alias("hidden"))


def labelled(d: Data) -> DataFrame:
    label = F.when(F.col("paper_id") % 4 == 0, "seed").when(F.col("paper_id") % 4 == 1, "liked")
    return d.px_papers.withColumn("label", label).withColumn("doi", F.concat(F.lit("10.1/A"), (F.col("paper_id") % 300).cast("string")))


@query("p13_unlabelled", "SELECT paper_id FROM px_papers WHERE paper_id % 4 > 1")
def unlabelled(d):
    return legacy.unlabelled(labelled(d)).select("paper_id")


@query("p13_with_label", "SELECT paper_id FROM px_papers WHERE paper_id % 4 = 1")
def with_label(d):
    return legacy.with_label(labelled(d), "liked").select("paper_id")


@query("p13_by_doi", "SELECT paper_id FROM px_papers WHERE paper_id % 300 IN (SELECT paper_id FROM px_anchors)")
def by_doi(d):
    asked = d.px_anchors.select(F.concat(F.lit(" 10.1/a"), F.col("paper_id").cast("string")).alias("doi"))
    return legacy.by_doi(labelled(d), asked).select("paper_id")


@query("p03_states", f"WITH {REPLAY} SELECT session_id, paper_id, state FROM px_nodes WHERE state IN ('SEED', 'LIKED')")
def states(d):
    return events.in_states(events.replay(d.px_events), events.parse_states(" seed,,Liked "))


@query("p02_added_by", f"WITH {REPLAY} SELECT paper_id FROM px_nodes WHERE session_id = 1 AND paper_id % 3 = 2")
def added_by(d):
    n = events.replay(d.px_events).withColumn("added_by", F.concat(F.lit("run"), (F.col("paper_id") % 3).cast("string")))
    return events.added_by(n, 1, "run2")


@query("p14_j10_graph_payload", f"WITH {REPLAY} SELECT n.paper_id, p.title, n.state, p.year, p.citation_count, p.venue FROM px_nodes n JOIN px_papers p ON p.paper_id = n.paper_id WHERE n.session_id = 1")
def payload(d):
    return nodes_of(d, 1).join(d.px_papers, "paper_id").select("paper_id", "title", "state", "year", "citation_count", "venue")


@query("j07_pool_exclusion", CASCADE_SQL.rstrip() + f", {REPLAY}, gone AS (SELECT paper_id FROM px_nodes WHERE session_id = 1 UNION SELECT paper_id FROM last_known WHERE session_id = 1 AND event_type IN ('REMOVED', 'GC_SWEPT') UNION SELECT paper_id FROM px_anchors UNION SELECT paper_id FROM judged WHERE v NOT LIKE 'ACCEPT%') SELECT paper_id FROM px_papers WHERE paper_id NOT IN (SELECT paper_id FROM gone)")
def exclusion(d):
    tombs = events.tombstones(d.px_events).where("session_id = 1")
    out = ranking.excluded(nodes_of(d, 1), tombs, filters.non_accepted(decisions_of(d), 1, PROXY.version), d.px_anchors)
    return d.px_papers.select("paper_id").join(out, "paper_id", "left_anti")


@query("a06_pool_accumulation", "SELECT l_partkey AS paper_id, count(DISTINCT l_suppkey) AS anchors, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS intents, bool_or(l_quantity > 45) AS influential FROM lineitem GROUP BY l_partkey")
def accumulation(d):
    return d.lineitem.groupBy(F.col("l_partkey").alias("paper_id")).agg(F.countDistinct("l_suppkey").alias("anchors"), F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("intents"), F.bool_or(F.col("l_quantity") > 45).alias("influential"))


@query("a08_completeness_by_category", "SELECT category, round(avg(CASE WHEN crawl_state <> 'STUB' THEN 1.0 ELSE 0.0 END), 4) AS completeness FROM px_papers GROUP BY category")
def completeness_by(d):
    return d.px_papers.groupBy("category").agg(F.round(F.avg((F.col("crawl_state") != "STUB").cast("double")), 4).alias("completeness"))


@query("a15_best_h_index", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE greatest(p_size, 3) END AS h FROM part")
def best_h(d):
    authors = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<struct<hIndex:int>>")).otherwise(F.array(F.struct(F.col("p_size").alias("hIndex")), F.struct(F.lit(3).alias("hIndex")), F.struct(F.lit(None).cast("int").alias("hIndex"))))
    return d.part.select("p_partkey", legacy.best_h_index(authors).alias("h"))


@query("k03_show_order", f"WITH {REPLAY} SELECT n.paper_id, n.state, row_number() OVER (ORDER BY CASE WHEN n.state = 'SEED' THEN 0 ELSE 1 END, p.citation_count DESC, n.paper_id) AS place FROM px_nodes n JOIN px_papers p ON p.paper_id = n.paper_id WHERE n.session_id = 1")
def show_order(d):
    rows = nodes_of(d, 1).join(d.px_papers, "paper_id")
    order = [F.when(F.col("state") == "SEED", 0).otherwise(1), F.desc("citation_count"), F.col("paper_id")]
    return numbered(rows, order, "place").select("paper_id", "state", "place")


@query("u07_remove_rows", f"WITH {REPLAY} SELECT session_id, count(*) AS n FROM px_nodes WHERE paper_id NOT IN (SELECT paper_id FROM px_anchors) GROUP BY session_id")
def remove_rows(d):
    n = events.replay(d.px_events).withColumn("depth", F.lit(1))
    gone = n.join(d.px_anchors, "paper_id", "left_semi")
    return events.remove(n, d.px_events, gone)[0].groupBy("session_id").agg(F.count("*").alias("n"))


@query("u07_positions", f"WITH {REPLAY} SELECT session_id, paper_id, CASE WHEN paper_id % 2 = 0 THEN CAST(paper_id AS DOUBLE) ELSE 0.0 END AS x, CASE WHEN paper_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS y FROM px_nodes")
def positions(d):
    n = events.replay(d.px_events).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    places = n.where("paper_id % 2 = 0").select("session_id", "paper_id", F.col("paper_id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    return events.set_positions(n, places).select("session_id", "paper_id", "x", "y")


@query("t04_restore", f"""WITH {REPLAY}, d AS (SELECT session_id, paper_id, coalesce(arg_max(depth, id) FILTER (WHERE event_type IN ('REMOVED', 'GC_SWEPT')), 1) AS depth FROM px_events GROUP BY 1, 2)
SELECT l.session_id, l.paper_id, 'CANDIDATE' AS state, d.depth FROM last_known l JOIN d ON d.session_id = l.session_id AND d.paper_id = l.paper_id WHERE l.event_type IN ('REMOVED', 'GC_SWEPT')
UNION ALL SELECT session_id, paper_id, state, 0 FROM px_nodes""")
def restore(d):
    n, asked = events.replay(d.px_events).withColumn("depth", F.lit(0)), d.px_events.select("session_id", "paper_id")
    return events.restore(n, d.px_events, asked)[0]


@query("u09_pool_union", "SELECT cited_id AS paper_id, count(DISTINCT citing_id) AS n FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors) GROUP BY cited_id")
def pool_union(d):
    own = d.px_anchors.withColumnRenamed("paper_id", "citing_id")
    return d.px_edges.join(own, "citing_id", "left_semi").groupBy(F.col("cited_id").alias("paper_id")).agg(F.countDistinct("citing_id").alias("n"))


@query("g14_full_reach", """WITH RECURSIVE e AS (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges),
walk AS (SELECT CAST(3 AS BIGINT) AS p UNION SELECT e.b FROM walk w JOIN e ON e.a = w.p) SELECT p AS paper_id FROM walk""")
def full_reach(d):
    return graph.reach(d.px_edges, d.px_anchors.where("paper_id = 3"), None).select("paper_id")


@query("g14_cascade_delete", """WITH RECURSIVE one AS (SELECT citing_id, min(cited_id) AS cited_id FROM px_edges WHERE cited_id > citing_id GROUP BY citing_id),
e AS (SELECT citing_id AS a, cited_id AS b FROM one UNION SELECT cited_id, citing_id FROM one),
walk AS (SELECT paper_id AS p FROM px_anchors UNION SELECT e.b FROM walk w JOIN e ON e.a = w.p) SELECT paper_id FROM px_papers WHERE paper_id NOT IN (SELECT p FROM walk)""")
def cascade_delete(d):
    # of every paper the citation of the next paper by id: a sparse graph, so that some papers go
    links = d.px_edges.where("cited_id > citing_id").groupBy("citing_id").agg(F.min("cited_id").alias("cited_id"))
    return graph.reachable(links, d.px_anchors, d.px_papers.select("paper_id"))[1]


@query("g15_explore_node", "SELECT other FROM (SELECT cited_id AS other FROM px_edges WHERE citing_id = 3 UNION SELECT citing_id FROM px_edges WHERE cited_id = 3) x JOIN px_papers p ON p.paper_id = x.other WHERE p.category IN ('STANDARD', 'PROMO')")
def explore_node(d):
    near = legacy.neighbours(d.px_edges, d.px_papers.where("paper_id = 3")).select("other").distinct()
    gate = d.px_papers.where(filters.broad_gate(F.array("category"), ("STANDARD", "PROMO"), ("LARGE", "MEDIUM", "SMALL", "ECONOMY"))).select(F.col("paper_id").alias("other"))
    return near.join(gate, "other", "left_semi")


@query("g16_quota", """WITH RECURSIVE o AS (SELECT cited_id AS paper_id, count(*) AS n, row_number() OVER (ORDER BY count(*), cited_id) AS i, count(*) OVER () AS c FROM px_edges GROUP BY cited_id),
w AS (SELECT i, paper_id, least(n, 9000 // c) AS taken, 9000 - least(n, 9000 // c) AS rest, c FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.paper_id, least(o.n, w.rest // (w.c - w.i)), w.rest - least(o.n, w.rest // (w.c - w.i)), w.c FROM w JOIN o ON o.i = w.i + 1)
SELECT 1 AS session_id, paper_id, taken FROM w""")
def expansion_quota(d):
    from biblioloom.operators import ingest

    n = d.px_edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("n"))
    return ingest.quota(n.withColumn("session_id", F.lit(1).cast("long")), 9000)


INGESTED = f"""WITH rec AS (SELECT citing_id AS center, cited_id AS paper_id FROM px_edges), {TITLED.replace('titled AS', 'titled0 AS')},
titled AS (SELECT * FROM titled0 WHERE paper_id IN (SELECT paper_id FROM rec)), stage AS (SELECT *, {ERA_SQL} AS e, {TYPE_SQL} AS t, {TOPIC_SQL} AS o FROM titled),
judged AS (SELECT *, CASE WHEN e NOT LIKE 'ACCEPT%' THEN e WHEN t NOT LIKE 'ACCEPT%' THEN t ELSE o END AS v FROM stage) """


@query("t06_ingest", INGESTED + "SELECT v LIKE 'ACCEPT%' AS admitted, count(*) AS n FROM judged GROUP BY 1")
def ingested(d):
    from biblioloom.operators import ingest

    near = d.px_edges.select(F.col("citing_id").alias("center"), F.col("cited_id").alias("paper_id"), F.lit("BACKWARD").alias("direction"))
    _, _, decisions = ingest.ingest(near.join(titled(d), "paper_id"), PROXY, AS_OF_YEAR)
    return ingest.boundary(decisions)


@query("t07_add_seeds", CASCADE_SQL + "SELECT paper_id, CASE WHEN v LIKE 'ACCEPT%' THEN NULL ELSE split_part(v, '|', 3) END AS forced_over FROM judged")
def seeds(d):
    from biblioloom.operators import ingest

    return ingest.add_seeds(titled(d), PROXY, AS_OF_YEAR, True).select("paper_id", "forced_over")


@query("t11_labels", "SELECT o_custkey AS paper_id, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '1-URGENT' ELSE arg_max(o_orderpriority, o_orderkey) END AS label FROM orders GROUP BY o_custkey")
def label_table(d):
    from biblioloom.operators import ingest

    return ingest.labels_table(d.orders.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq")), ("1-URGENT",))


@query("t11_delete_by_label", "SELECT citing_id, cited_id FROM px_edges WHERE citing_id % 4 <> 1 AND cited_id % 4 <> 1")
def delete_by_label(d):
    from biblioloom.operators import ingest

    return ingest.without_label(labelled(d), "liked", d.px_edges)[1]


@query("t11_seed_log", "SELECT o_clerk AS title, min(o_orderdate) AS first_seen_at FROM (SELECT o_orderpriority AS o_clerk, o_orderdate FROM orders) x GROUP BY o_clerk")
def seed_log(d):
    from biblioloom.operators import ingest

    rows = d.orders.select(F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("first_seen_at"), "o_orderkey")
    return ingest.log_seeds(rows.where("o_orderkey % 2 = 0").drop("o_orderkey"), rows.where("o_orderkey % 2 = 1").drop("o_orderkey"))


@query("w07_unique_ranking", f"WITH {REPEATED} SELECT case_id, paper_id, row_number() OVER (PARTITION BY case_id ORDER BY min(rank)) AS rank FROM twice WHERE rank <= 20 GROUP BY case_id, paper_id")
def unique_ranking(d):
    return evaluation.unique_ranking(repeated(d), 20).select("case_id", "paper_id", F.col("rank").cast("long").alias("rank"))


@query("s02_snapshot_watermark", "SELECT count(*) FILTER (WHERE p_partkey % 10 <> 0) AS loaded, count(*) FILTER (WHERE p_partkey % 10 = 0) AS skipped, CASE WHEN count(*) > 0 THEN '2020-01-01' END AS watermark FROM part")
def watermark(d):
    k = F.col("p_partkey")
    good = F.to_json(F.struct(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.lit("cs.X").alias("categories"), F.lit("2020-01-01").alias("update_date")))
    return metadata.watermark(d.part.select(F.when(k % 10 == 0, F.lit("{")).otherwise(good).alias("value")))


def harvest_page(d: Data) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    record = lambda i, extra: F.concat(F.lit('<record><metadata><a:arXiv xmlns:a="http://x/"><a:id>'), F.lit(i), k, F.lit("</a:id>"), extra, F.lit("</a:arXiv></metadata></record>"))
    good = record("id", F.concat(F.lit("<a:categories>"), F.col("p_type"), F.lit(" cs.X</a:categories><a:created>2020</a:created>")))
    token = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("t"), k)).otherwise(F.lit(" "))
    return d.part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<OAI-PMH xmlns="http://o/"><ListRecords>'), good, record("bad", F.lit("")), F.lit("<resumptionToken>"), token, F.lit("</resumptionToken></ListRecords></OAI-PMH>")).alias("value"))


@query("s03_harvest_pages", "SELECT 'id' || p_partkey AS arxiv_id, p_type AS primary_category, '2020' AS updated FROM part")
def harvest_records(d):
    return metadata.harvest_pages(harvest_page(d))[0].select("arxiv_id", "primary_category", "updated")


@query("s03_harvest_tokens", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 't' || p_partkey END AS token FROM part")
def harvest_tokens(d):
    return metadata.harvest_pages(harvest_page(d))[1]


@query("s12_cache", """WITH put AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'null' WHEN c_custkey % 2 = 0 THEN '{"v":' || c_nationkey || '}' END AS r FROM customer)
SELECT k AS c_custkey, r IS NOT NULL AS hit, r AS response FROM put""")
def cache(d):
    k = F.col("c_custkey").cast("string")
    asked = d.customer.select("c_custkey", F.lit("/paper").alias("endpoint"), F.create_map(F.lit("id"), k).alias("params"), "c_nationkey")
    held = asked.where("c_custkey % 2 = 0").withColumn("params_hash", metadata.cache_key(F.col("endpoint"), F.col("params")))
    answer = F.when(F.col("c_custkey") % 6 == 0, "null").otherwise(F.concat(F.lit('{"v":'), F.col("c_nationkey").cast("string"), F.lit("}")))
    fresh = held.select("endpoint", "params_hash", F.lit(200).alias("status_code"), answer.alias("response"), F.lit("2001-01-02").alias("fetched_at"))
    old = fresh.withColumn("response", F.lit("old")).withColumn("fetched_at", F.lit("2001-01-01"))
    return metadata.cache_get(metadata.cache_put(old, fresh), asked).select("c_custkey", "hit", "response")


@query("s18_file_cache", "SELECT c_custkey, sha256('k' || c_custkey) || '.json' AS file, c_custkey % 3 <> 0 AS readable FROM customer")
def file_cache(d):
    k = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    rows = d.customer.select(k.alias("key"), F.when(F.col("c_custkey") % 3 == 0, "{broken").otherwise('{"a": 1}').alias("value"))
    return metadata.file_cache(rows).select(F.substring("key", 2, 20).cast("long").alias("c_custkey"), "file", F.col("value").isNotNull().alias("readable"))


@query("s16_works", "SELECT 'W' || p_partkey AS paper_id, p_name AS title, 'b a b' AS abstract, p_size AS year, '10.1/x' || p_partkey AS doi, CASE WHEN p_partkey % 2 = 0 THEN '2001.' || p_partkey END AS arxiv_id, 0 AS citation_count, p_brand AS fields, 'Ada' AS authors FROM part")
def works(d):
    k = F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    arxiv = F.when(F.col("p_partkey") % 2 == 0, text('"ids":{"arxiv":"https://arxiv.org/abs/2001.', k, '"},')).otherwise("")
    value = text('{"id":"https://openalex.org/W', k, '","doi":"https://doi.org/10.1/x', k, '","display_title":', F.to_json(F.struct(F.col("p_name").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("p_name").alias("t")))) - 6), ',"publication_year":', F.col("p_size").cast("string"), ",", arxiv, '"authorships":[{"author":{"display_name":"Ada"}},{"author":null}],"concepts":[{"display_name":"', F.col("p_brand"), '","level":1},{"display_name":"z","level":2},{"display_name":"y"}],"abstract_inverted_index":{"a":[1],"b":[0,2]}}')
    rows = metadata.works(d.part.select(value.alias("value")))
    return rows.select("paper_id", "title", "abstract", "year", "doi", "arxiv_id", "citation_count", F.concat_ws(",", "field_of_study").alias("fields"), F.concat_ws(",", "authors").alias("authors"))


@query("s17_records", "SELECT 's' || p_partkey AS paper_id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS title, p_size AS year, 'x' || p_partkey AS doi, 'tl' AS tldr, 2 AS dims, 'Ada' AS authors FROM part")
def records(d):
    k = F.col("p_partkey").cast("string")
    author = F.array(F.struct(F.lit("Ada").alias("name")), F.struct(F.lit(None).cast("string").alias("name")))
    value = F.to_json(F.struct(
        F.concat(F.lit("s"), k).alias("paperId"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("title"), F.col("p_size").alias("year"),
        F.struct(F.concat(F.lit("x"), k).alias("DOI")).alias("externalIds"), F.struct(F.lit("tl").alias("text")).alias("tldr"), F.struct(F.array(F.lit(0.5), F.lit(1.0)).alias("vector")).alias("embedding"), author.alias("authors"),
    ))
    rows = metadata.records(d.part.select(value.alias("value")))
    return rows.select("paper_id", "title", "year", "doi", "tldr", F.size("embedding").alias("dims"), F.concat_ws(",", "authors").alias("authors"))


@query("u03_stub", """SELECT paper_id, 'METADATA' AS crawl_state, citation_count FROM px_papers UNION ALL
SELECT DISTINCT l_suppkey + 10000000, 'STUB', 0 FROM lineitem""")
def stubs(d):
    known = d.px_papers.select("paper_id", F.lit("METADATA").alias("crawl_state"), "citation_count", "venue", "year", F.lit(1).cast("long").alias("seq"), F.lit("2000").alias("first_seen_at"))
    ids = d.lineitem.select((F.col("l_suppkey") + 10_000_000).alias("paper_id")).distinct().unionByName(d.px_papers.select("paper_id"))
    late = corpus.stub(ids.select("paper_id", F.lit(2).cast("long").alias("seq"), F.lit("2001").alias("first_seen_at")))
    return corpus.merge_papers(known.unionByName(late)).select("paper_id", "crawl_state", "citation_count")


@query("u10_reuse_by_doi", "SELECT o_orderkey, coalesce((SELECT min(p.paper_id) FROM px_papers p WHERE p.paper_id % 300 = o.o_custkey % 400), o_orderkey) AS paper_id FROM orders o")
def reuse_by_doi(d):
    w = d.orders.select("o_orderkey", F.col("o_orderkey").alias("paper_id"), F.concat(F.lit("10.1/a"), (F.col("o_custkey") % 400).cast("string")).alias("doi"))
    return corpus.reuse_by_doi(labelled(d), w).select("o_orderkey", "paper_id")


@query("s11_neighbour_pages", "SELECT 'p' || l_partkey AS citing, 'c' || l_orderkey AS cited, 'FORWARD' AS direction, bool_or(l_quantity > 45) AS is_influential FROM lineitem GROUP BY 1, 2")
def neighbour_pages(d):
    item = F.struct(F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("paperId")).alias("citingPaper"), (F.col("l_quantity") > 45).alias("isInfluential"))
    pages = d.lineitem.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("center"), F.lit("FORWARD").alias("direction"), F.to_json(F.struct(F.array(item).alias("data"))).alias("value"))
    return metadata.neighbour_edges(pages).groupBy("citing", "cited", "direction").agg(F.bool_or("is_influential").alias("is_influential"))


@query("s20_seed_lines", "SELECT p_partkey AS pos, trim(p_name) AS title FROM part WHERE p_partkey % 5 <> 0")
def seed_lines(d):
    k = F.col("p_partkey")
    return metadata.seed_lines(d.part.select(k.alias("pos"), F.when(k % 10 == 0, " # x").when(k % 5 == 0, "  ").otherwise(F.concat("p_name", F.lit(" "))).alias("value")))


#: The policy's terms, and one that the invented texts hold.
APPLIED = (*DEFAULT.applied_terms, "idiot")


@query("x14_applied_terms", "SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in APPLIED) + " THEN 'QUARANTINE|APPLIED|APPLIED_TERM' ELSE 'ACCEPT|APPLIED|OK' END AS verdict FROM documents")
def applied_terms(d):
    return d.documents.select("doc_id", told(filters.applied(F.col("text"), DEFAULT.merged(applied_terms=APPLIED))).alias("verdict"))


from biblioloom.plans import more  # noqa: E402, F401  (registers further queries)
