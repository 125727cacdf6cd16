"""Further registered queries: communities, vectors, streams and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from biblioloom.config import AS_OF_YEAR, PROXY
from biblioloom.functions import scores
from biblioloom.operators import communities, evaluation, events, filters, graph, ranking, vectors
from biblioloom.operators.lineage import shared_folder, written
from biblioloom.plans import proxy
from biblioloom.plans.queries import CASCADE_SQL, RANKED, RATE, RECENCY, REPLAY, candidates_of, query, titled, truth_of
from biblioloom.sources import archive, metadata
from biblioloom.sources.stored import Versioned
from biblioloom.streaming import replay

# Communities ----------------------------------------------------------------------------------


@query("x14_modularity", """WITH link AS (SELECT DISTINCT least(citing_id, cited_id) AS a, greatest(citing_id, cited_id) AS b FROM px_edges),
ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
named AS (SELECT p.category AS one, q.category AS two FROM ends JOIN px_papers p ON p.paper_id = a JOIN px_papers q ON q.paper_id = b),
sums AS (SELECT one, count(*) AS k, count(*) FILTER (one = two) AS inside FROM named GROUP BY one)
SELECT round(sum(inside) / sum(k) - sum(CAST(k AS DOUBLE) * k) / (CAST(sum(k) AS DOUBLE) * sum(k)), 9) AS modularity FROM sums""")
def modularity(d):
    labels = d.px_papers.select(F.col("paper_id").alias("node"), F.hash("category").alias("community"))
    return communities.modularity(communities.links_of(d.px_edges), labels).select(F.round("modularity", 9).alias("modularity"))


@query("x14_leiden")
def leiden(d):
    links, drop = written(communities.links_of(d.px_edges))
    found = communities.leiden(links)
    drop()
    return found.select(F.col("node").alias("paper_id"), F.col("community").alias("community_id"))

# Vectors --------------------------------------------------------------------------------------

COSINE = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@query("x14_vector_search", f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
scored AS (SELECT q.id AS query, b.id, {COSINE.format(a="q.x", b="b.x")} AS cosine FROM v q JOIN v b ON q.id % 100 = 0 AND q.id <> b.id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank, id, round(cosine, 6) AS cosine FROM scored
QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) <= 10""")
def vector_search(d):
    rows = d.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.Index(rows).search(rows.where("id % 100 = 0"), 10)
    return found.select("query", "rank", "id", F.round("cosine", 6).alias("cosine"))


@query("x14_embedding_channel", f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
scored AS (SELECT q.id AS query, b.id, {COSINE.format(a="q.x", b="b.x")} AS cosine FROM v q JOIN v b ON q.id < 10 AND q.id <> b.id),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM scored QUALIFY rank <= 20),
near AS (SELECT paper_id AS p FROM px_anchors UNION SELECT cited_id FROM px_edges WHERE citing_id IN (SELECT paper_id FROM px_anchors)
  UNION SELECT citing_id FROM px_edges WHERE cited_id IN (SELECT paper_id FROM px_anchors))
SELECT query, rank, id, round(cosine, 6) AS cosine FROM best WHERE id NOT IN (SELECT p FROM near)""")
def embedding_channel(d):
    """What the vectors propose for the anchors and the citation graph does not, within one step."""
    rows = d.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.join(d.px_anchors.select(F.col("paper_id").alias("id")), "id", "left_semi")
    found = vectors.Index(rows).search(asked, 20)
    return vectors.unreached(found, graph.reach(d.px_edges, d.px_anchors, 1)).select("query", "rank", "id", F.round("cosine", 6).alias("cosine"))


#: The vectors with near copies of every fifth and equal copies of every ninth.
COPIED = """SELECT vec_id AS id, {whole} AS vector FROM embeddings
UNION ALL SELECT vec_id + 1000000, {jittered} FROM embeddings WHERE vec_id % 5 = 0
UNION ALL SELECT vec_id + 2000000, {whole} FROM embeddings WHERE vec_id % 9 = 0"""
SPARK_COPIED = COPIED.format(whole="CAST(embedding AS ARRAY<DOUBLE>)", jittered="transform(embedding, (x, i) -> CAST(x AS DOUBLE) + 0.01D * CAST((vec_id + i) % 7 - 3 AS DOUBLE))").replace("FROM embeddings", "FROM {e}")
DUCK_COPIED = COPIED.format(whole="CAST(embedding AS DOUBLE[])", jittered="list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CAST(0.01 AS DOUBLE) * CAST((vec_id + i - 1) % 7 - 3 AS DOUBLE))")


def copied(d):
    return d.spark.sql(SPARK_COPIED, e=d.embeddings)


@query("x14_duplicate_pairs", f"""WITH v AS ({DUCK_COPIED}), u AS (SELECT min(id) AS id, vector AS x FROM v GROUP BY vector)
SELECT a.id AS a, b.id AS b, round({COSINE.format(a="a.x", b="b.x")}, 6) AS cosine FROM u a JOIN u b ON a.id < b.id WHERE {COSINE.format(a="a.x", b="b.x")} > 0.97""")
def duplicate_pairs(d):
    return vectors.duplicates(copied(d)).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("x14_duplicate_classes", f"WITH v AS ({DUCK_COPIED}) SELECT id, min(id) OVER (PARTITION BY vector) AS representative FROM v")
def duplicate_classes(d):
    return vectors.classes(copied(d))


@query("x14_duplicate_review", f"""WITH v AS ({DUCK_COPIED}), u AS (SELECT min(id) AS id, vector AS x FROM v GROUP BY vector),
pairs AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE {COSINE.format(a="a.x", b="b.x")} > 0.97),
papers AS (SELECT vec_id AS paper_id, CASE WHEN vec_id % 2 = 0 THEN 'Paper no ' ELSE 'One Paper, No. ' END || vec_id AS title FROM embeddings
  UNION ALL SELECT vec_id + 1000000, 'Paper no ' || vec_id FROM embeddings),
plain AS (SELECT paper_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS t FROM papers)
SELECT a, b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 6) AS title_likeness
FROM pairs JOIN plain x ON x.paper_id = a JOIN plain y ON y.paper_id = b
WHERE 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.9""")
def duplicate_review(d):
    titles = d.spark.sql("""SELECT vec_id AS paper_id, concat(CASE WHEN vec_id % 2 = 0 THEN 'Paper no ' ELSE 'One Paper, No. ' END, vec_id) AS title FROM {e}
        UNION ALL SELECT vec_id + 1000000, concat('Paper no ', vec_id) FROM {e}""", e=d.embeddings)
    return vectors.review(vectors.duplicates(copied(d)), titles, 0.9).select("a", "b", F.round("title_likeness", 6).alias("title_likeness"))

# Streams --------------------------------------------------------------------------------------


def streamed(d, name, **options):
    """A given table as a stream of its files, whether it is one file or a folder of them."""
    table = d.spark.read.parquet(f"{d.sf_dir}/{name}.parquet")
    stream = d.spark.readStream.schema(table.schema).options(**options)
    if table.inputFiles()[0].endswith(f"/{name}.parquet"):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(d.sf_dir)
    return stream.parquet(f"{d.sf_dir}/{name}.parquet")


@query("t_replay_state", f"WITH {REPLAY} SELECT session_id, paper_id, state FROM px_nodes")
def replay_state(d):
    """The log as a stream into keyed state and from there into stored nodes; the same rows as the replay in batch."""
    top = f"{shared_folder(d.spark)}/replay-{uuid.uuid4().hex}"
    nodes = Versioned(d.spark, f"{top}/nodes")
    events = d.spark.sql(proxy.EVENTS, events=streamed(d, "events"))
    replay.replay_into(events, nodes, f"{top}/checkpoint").awaitTermination()
    return replay.nodes_of(nodes.read("nodes")).select("session_id", "paper_id", "state")


LABELLED = """SELECT session_id, paper_id, CASE WHEN paper_id % 3 = 0 THEN 'LIKED' WHEN paper_id % 3 = 1 THEN 'DISLIKED' ELSE 'CANDIDATE' END AS to_state, paper_id AS seq
FROM px_nodes WHERE session_id < 3"""


@query("t_label_batches", f"""WITH {REPLAY}, asked AS ({LABELLED}),
changed AS (SELECT n.session_id, n.paper_id, n.state AS from_state, a.to_state FROM px_nodes n JOIN asked a USING (session_id, paper_id) WHERE n.state <> a.to_state AND n.state <> 'SEED'),
after AS (SELECT n.session_id, n.paper_id, coalesce(c.to_state, n.state) AS state FROM px_nodes n LEFT JOIN changed c USING (session_id, paper_id)),
losing AS (SELECT DISTINCT session_id FROM changed WHERE from_state = 'LIKED'),
near AS (SELECT citing_id AS a, cited_id AS b FROM px_edges UNION SELECT cited_id, citing_id FROM px_edges),
links AS (SELECT x.session_id, n.a, n.b FROM near n JOIN after x ON x.paper_id = n.a JOIN after y ON y.paper_id = n.b AND y.session_id = x.session_id),
d0 AS (SELECT session_id, paper_id FROM after WHERE state IN ('SEED', 'LIKED')),
d1 AS (SELECT * FROM d0 UNION SELECT l.session_id, l.b FROM d0 JOIN links l ON l.session_id = d0.session_id AND l.a = d0.paper_id),
writer AS (SELECT session_id, paper_id, CASE WHEN paper_id % 4 = 1 THEN 'SYSTEM' ELSE arg_max(actor, id) END AS actor FROM px_events GROUP BY session_id, paper_id),
swept AS (SELECT x.session_id, x.paper_id FROM after x JOIN losing USING (session_id) LEFT JOIN writer w ON w.session_id = x.session_id AND w.paper_id = x.paper_id
  WHERE x.state = 'CANDIDATE' AND (x.session_id, x.paper_id) NOT IN (SELECT session_id, paper_id FROM d1)
    AND NOT coalesce(w.actor = 'USER', false) AND (x.session_id, x.paper_id) NOT IN (SELECT session_id, paper_id FROM changed))
SELECT x.session_id, x.paper_id, x.state FROM after x LEFT JOIN swept s ON s.session_id = x.session_id AND s.paper_id = x.paper_id WHERE s.paper_id IS NULL""")
def label_batches(d):
    """Label requests in one atomic batch against stored nodes and log, delivered twice; every fourth paper is held by no user."""
    store = Versioned(d.spark, f"{shared_folder(d.spark)}/labels-{uuid.uuid4().hex}")
    nodes = events.replay(d.px_events).withColumn("depth", F.lit(0))
    store.commit({"nodes": nodes, "log": d.px_events.select("id", "session_id", "paper_id", "event_type", F.when(F.col("paper_id") % 4 == 1, "SYSTEM").otherwise(F.col("actor")).alias("actor"), "depth")})
    asked = d.spark.sql(LABELLED.replace("px_nodes", "{n}"), n=store.read("nodes"))
    writer = replay.LabelWriter(store, d.px_edges, PROXY.merged(max_depth=1))
    writer.write(asked, 0)
    writer.write(asked, 0)
    return store.read("nodes").select("session_id", "paper_id", "state")


# Evaluation of a weight grid ------------------------------------------------------------------


@query("x14_grid_metrics", f"""WITH {RANKED.split("truth AS")[0].rstrip().rstrip(",")}, truth AS (SELECT citing_id AS case_id, cited_id AS paper_id FROM px_edges WHERE cited_id % 3 = 0),
n AS (SELECT case_id, count(*) AS n FROM truth GROUP BY case_id),
grid AS (SELECT CAST(i * 10 + j AS INT) AS run, CAST(i AS DOUBLE) / 10 AS a, CAST(j AS DOUBLE) / 10 AS b FROM range(10) x(i), range(10) y(j)),
scored AS (SELECT g.run, c.case_id, c.paper_id, 0.0 + g.a * ({RATE}) + g.b * ({RECENCY}) AS score FROM cand c JOIN px_papers p ON p.paper_id = c.paper_id, grid g),
placed AS (SELECT *, row_number() OVER (PARTITION BY run, case_id ORDER BY score DESC, paper_id) AS rank FROM scored),
hit AS (SELECT p.run, p.case_id, min(rank) AS best, count(*) FILTER (rank <= 20) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 20), 0) AS dcg
  FROM placed p JOIN truth t ON t.case_id = p.case_id AND t.paper_id = p.paper_id GROUP BY p.run, p.case_id),
ideal AS (SELECT case_id, n, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 21)) AS i) WHERE i <= n.n) AS idcg FROM n)
SELECT g.run, round(avg(coalesce(f, 0) / CAST(n AS DOUBLE)), 6) AS recall, round(avg(CAST(coalesce(f, 0) > 0 AS INT)), 6) AS hit, round(avg(coalesce(1.0 / best, 0)), 6) AS rr,
  round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg, count(*) AS cases
FROM ideal i CROSS JOIN grid g LEFT JOIN hit h ON h.case_id = i.case_id AND h.run = g.run GROUP BY g.run""")
def grid_metrics(d):
    made = F.create_map(F.lit("quality"), scores.ranked_rate(F.col("citation_count"), F.col("year"), AS_OF_YEAR), F.lit("recency"), scores.recency(F.col("year"), AS_OF_YEAR))
    grid = [{"quality": i / 10, "recency": j / 10} for i in range(10) for j in range(10)]
    found = evaluation.sweep_metrics(candidates_of(d).withColumn("features", made), truth_of(d).where("paper_id % 3 = 0"), grid, 20)
    return found.select("run", *[F.round(c, 6).alias(c) for c in ("recall", "hit", "rr", "ndcg")], "cases")


# Sources --------------------------------------------------------------------------------------


@query("s11_neighbour_papers", """SELECT 'c' || l_orderkey AS center, 'BACKWARD' AS direction, 'p' || l_partkey AS s2_paper_id, p_name AS title, CAST(p_size AS INT) AS year,
  CASE WHEN p_partkey % 2 = 0 THEN l_linenumber ELSE 0 END AS citation_count, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n_authors
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 7 <> 0""")
def neighbour_papers(d):
    rows = d.lineitem.join(d.part, F.col("p_partkey") == F.col("l_partkey"))
    k, odd = F.col("p_partkey"), F.col("p_partkey") % 2
    author = lambda i, n: F.struct(F.lit(i).cast("string").alias("authorId"), F.lit(n).cast("string").alias("name"))
    paper = F.struct(
        F.concat(F.lit("p"), k.cast("string")).alias("paperId"), F.when(k % 7 != 0, F.col("p_name")).alias("title"), F.col("p_size").alias("year"),
        F.when(odd == 0, F.col("l_linenumber")).alias("citationCount"), F.struct(F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("DOI")).alias("externalIds"),
        F.when(odd == 0, F.array(author("1", "A"), author(None, "B"), author("2", None))).alias("authors"),
    )
    center = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"))
    own = F.struct(F.struct(center.alias("paperId"), F.lit("itself").alias("title")).alias("citedPaper"))
    value = F.concat(F.lit('{"data":['), F.to_json(F.struct(paper.alias("citedPaper"))), F.lit(","), F.to_json(own), F.lit("]}"))
    found = metadata.neighbour_papers(rows.select(center.alias("center"), F.lit("BACKWARD").alias("direction"), value.alias("value")))
    return found.select("center", "direction", "s2_paper_id", "title", "year", "citation_count", "doi", F.greatest(F.size("authors"), F.lit(0)).alias("n_authors"))


@query("s15_export", "SELECT paper_id, title, venue, year, citation_count FROM px_papers")
def export(d):
    """Written as CSV and read back."""
    path = f"{shared_folder(d.spark)}/export-{uuid.uuid4().hex}"
    rows = d.px_papers.select("paper_id", "title", "venue", "year", "citation_count")
    metadata.export(rows, path, "csv")
    return d.spark.read.schema(rows.schema).csv(path, header=True)


@query("s02_archive_snapshot", """SELECT count(*) FILTER (WHERE p_partkey % 10 <> 0) AS loaded, count(*) FILTER (WHERE p_partkey % 10 = 0) AS skipped, max(CASE WHEN p_partkey % 10 <> 0 THEN '20' || lpad(CAST(p_size AS VARCHAR), 2, '0') END) AS watermark FROM part""")
def archive_snapshot(d):
    """Lines of the parts, written as compressed archives by Spark's tasks and read member by member."""
    path = f"{shared_folder(d.spark)}/archives-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    good = F.to_json(F.struct(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.lit("cs.X").alias("categories"), F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("update_date")))
    lines = d.part.select(F.when(k % 10 == 0, F.lit("{")).otherwise(good).alias("value"))
    archive.write_archives(lines, path)
    return metadata.watermark(archive.read_archives(d.spark, path, 4096).select("value"))


@query("f11_counted_cascade", CASCADE_SQL + """SELECT count(*) AS papers, count(*) FILTER (paper_id % 4 = 0) AS hits, count(*) FILTER (outcome = 'ACCEPT') AS accepted,
  count(*) FILTER (outcome = 'QUARANTINE') AS quarantined, count(*) FILTER (outcome = 'REJECT') AS rejected
FROM (SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN 'REJECT' ELSE split_part(v, '|', 1) END AS outcome FROM judged)""")
def counted_cascade(d):
    """Verdicts are written once; the counts come from that same pass."""
    known = d.px_papers.where("paper_id % 4 = 0").select(
        "paper_id", F.lit(None).cast("long").alias("session_id"), F.lit(PROXY.version).alias("config_version"),
        F.lit("REJECT").alias("outcome"), F.lit("TYPE").alias("stage"), F.lit("IS_DATASET").alias("reason"),
    )
    judged, seen = filters.counted_cascade(titled(d), known, PROXY, AS_OF_YEAR)
    judged.write.parquet(f"{shared_folder(d.spark)}/judged-{uuid.uuid4().hex}")
    names = ("papers", "hits", "accepted", "quarantined", "rejected")
    return d.spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


# Author prior ---------------------------------------------------------------------------------


@query("x14_author_prior", """WITH byline AS (SELECT l_partkey AS paper_id, o_custkey AS author_id, min(l_orderkey) AS position FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY 1, 2),
author AS (SELECT c_custkey AS author_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 60 END AS h_index FROM customer),
found AS (SELECT paper_id, max(h_index) AS h, count(h_index) AS known, string_agg(name, ';' ORDER BY position, name) AS authors FROM byline JOIN author USING (author_id) GROUP BY paper_id),
rows AS (SELECT p.paper_id, f.h, coalesce(f.known, 0) AS known, coalesce(f.authors, '') AS authors, CASE WHEN p.year >= 1999 THEN f.h END AS own FROM px_papers p LEFT JOIN found f ON f.paper_id = p.paper_id),
pct AS (SELECT own, dense_rank() OVER (ORDER BY own) - 1 AS i FROM (SELECT DISTINCT own FROM rows WHERE own IS NOT NULL))
SELECT r.paper_id, r.h AS h_index, r.known, r.authors, round(CASE WHEN (SELECT count(*) FROM pct) = 1 AND r.own IS NOT NULL THEN 0.5 ELSE i / CAST((SELECT max(i) FROM pct) AS DOUBLE) END, 9) AS author_prior
FROM rows r LEFT JOIN pct ON pct.own = r.own""")
def author_prior(d):
    first = d.lineitem.where("l_linenumber = 1").join(d.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    bylines = first.groupBy(F.col("l_partkey").alias("paper_id"), F.col("o_custkey").alias("author_id")).agg(F.min("l_orderkey").alias("position"))
    k = F.col("c_custkey")
    authors = d.customer.select(k.alias("author_id"), F.col("c_name").alias("name"), F.when(k % 3 != 0, k % 60).alias("h_index"))
    found = ranking.author_prior(d.px_papers, bylines, authors, F.col("year") >= 1999)
    return found.select("paper_id", "h_index", "known", F.array_join("authors", ";").alias("authors"), F.round("author_prior", 9).alias("author_prior"))
