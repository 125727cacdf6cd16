"""A citation corpus in terms of the order tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAPERS = """
SELECT p.p_partkey AS paper_id, p.p_name AS title, p.p_brand AS venue, p.p_type AS category,
  CASE WHEN p.p_size = 7 THEN NULL ELSE CAST(1990 + p.p_size % 12 AS INT) END AS year,
  CAST(coalesce(c.n, 0) AS BIGINT) AS citation_count,
  CASE WHEN p.p_size % 5 = 0 THEN 'STUB' ELSE 'METADATA' END AS crawl_state
FROM {part} p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) c ON c.l_partkey = p.p_partkey"""
EDGES = """
SELECT DISTINCT a.l_partkey AS citing_id, b.l_partkey AS cited_id
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey"""
#: The same edges with what is known of each citation.
CITES = """
SELECT a.l_partkey AS citing_id, b.l_partkey AS cited_id, bool_or(a.l_quantity > 45) AS is_influential,
  array_agg(DISTINCT CASE a.l_returnflag WHEN 'R' THEN 'methodology' WHEN 'A' THEN 'background' ELSE 'result' END) AS intents
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey"""
EVENTS = """
SELECT event_id AS id, user_id % 3 AS session_id, k AS paper_id,
  CASE event_type WHEN 'purchase' THEN 'SEED_ADDED' WHEN 'click' THEN 'LIKED' WHEN 'view' THEN 'UNLABELED'
    WHEN 'signup' THEN 'RESTORED' ELSE CASE WHEN k % 2 = 0 THEN 'GC_SWEPT' ELSE 'REMOVED' END END AS event_type,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'SYSTEM' ELSE 'USER' END AS actor,
  CAST(event_id % 4 AS INT) AS depth
FROM (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e"""
#: Papers 0 to 9 are the anchors of session 1.
ANCHORS = "SELECT p_partkey AS paper_id FROM {part} WHERE p_partkey < 10"
TABLES = {"px_papers": PAPERS, "px_edges": EDGES, "px_cites": CITES, "px_events": EVENTS, "px_anchors": ANCHORS}
BASES = ("part", "lineitem", "events")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = TABLES[name]
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASES if "{" + b + "}" in sql}
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """``sql`` with the proxy tables that it names as CTEs, for DuckDB."""
    named = [n for n in TABLES if n in sql]
    plain = {b: b for b in BASES}
    ctes = [f"{n} AS ({TABLES[n].format(**plain)})" for n in named]
    if not ctes:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    body = body[len("WITH RECURSIVE") :] if recursive else body[4:] if body.upper().startswith("WITH ") else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + (",\n" + body if body is not None else "\n" + sql)
