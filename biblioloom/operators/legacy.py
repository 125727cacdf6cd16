"""The older scorers and expanders, and what the views compute from graph rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioloom.functions import scores


def seed_metrics(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each neighbour: how many seeds cite it, how many it cites, and their sum."""
    own = seeds.select("paper_id").distinct()
    cited = edges.join(own.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").select(F.col("cited_id").alias("paper_id"), F.lit(1).alias("by"), F.lit(0).alias("to"))
    citing = edges.join(own.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi").select(F.col("citing_id").alias("paper_id"), F.lit(0).alias("by"), F.lit(1).alias("to"))
    both = cited.unionByName(citing).join(own, "paper_id", "left_anti")
    return both.groupBy("paper_id").agg(F.sum("by").alias("cited_by_seeds"), F.sum("to").alias("cites_seeds"), F.sum(F.col("by") + F.col("to")).alias("co_citation"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_id, other, direction) of each node's edges: cites (out) and cited-by (in)."""
    own = nodes.select("paper_id").distinct()
    out = edges.select(F.col("citing_id").alias("paper_id"), F.col("cited_id").alias("other"), F.lit("out").alias("direction"))
    into = edges.select(F.col("cited_id").alias("paper_id"), F.col("citing_id").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(into).join(own, "paper_id", "left_semi")


def centroid(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    each = rows.select(by, F.posexplode(vector).alias("pos", "v"))
    means = each.groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    return means.groupBy(by).agg(ordered.alias("centroid"))


def wave_share(rows: DataFrame, value: str, wave: str, name: str) -> DataFrame:
    """A value by the largest of its wave; 0 where that is not positive."""
    top = F.max(value).over(Window.partitionBy(wave))
    return rows.withColumn(name, F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0)))


def boosted(score: Column, recommended: Column, by: float = 0.15) -> Column:
    return F.when(F.coalesce(recommended, F.lit(False)), F.least(score + by, F.lit(1.0))).otherwise(score)


def expand_levels(edges: DataFrame, seeds: DataFrame, depth: int, cap: int, citations: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """(paper_id, level, connections): breadth-first expansion by levels. Each level adds its ``cap`` most cited new
    neighbours, while there are fewer than ``max_nodes`` papers in all; the seeds' own references are added whatever the caps.

    ``connections`` are the seeds that reach a paper through the papers that brought it in.
    """
    from biblioloom.operators.lineage import cut

    own = seeds.select("paper_id").distinct()
    seen = cut(own.select("paper_id", F.lit(0).alias("level"), F.array("paper_id").alias("connections")))
    rim = seen
    for step in range(1, depth + 1):
        near = neighbours(edges, rim).join(rim.select("paper_id", F.col("connections").alias("_c")), "paper_id")
        new = near.groupBy(F.col("other").alias("paper_id")).agg(
            F.max((F.col("direction") == "out").cast("int")).alias("ref"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_c")))).alias("connections")
        )
        new = new.join(seen, "paper_id", "left_anti").join(citations.select("paper_id", "citation_count"), "paper_id", "left").na.fill(0, ["citation_count"])
        new = cut(new)
        room = cap if max_nodes is None else max(0, min(cap, max_nodes - seen.count()))
        best = new.orderBy(F.desc("citation_count"), F.asc("paper_id")).limit(room)
        if step == 1:
            best = best.unionByName(new.where("ref = 1")).dropDuplicates(["paper_id"])
        rim = cut(best.select("paper_id", F.lit(step).alias("level"), "connections"))
        seen = cut(seen.unionByName(rim))
    return seen


def node_score(similarity: Column, citations: Column, recent: Column, year: Column) -> Column:
    """Thirds; a fifth of the citations' weight moves to recency from 2026 on."""
    third = 1.0 / 3
    late = third * similarity + third * 0.8 * citations + (third + third * 0.2) * recent
    return F.when(year >= 2026, late).otherwise(third * (similarity + citations + recent))


def visible_at(state: Column, score: Column, threshold: float) -> Column:
    return (state != "CANDIDATE") | (F.coalesce(score, F.lit(0.0)) >= threshold)


def matches(title: Column, query: str) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).contains(query.lower()) if query.strip() else F.lit(False)


def score_bars(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """Each term of a breakdown with its share of the largest one and its sign, largest first."""
    each = rows.select(key, F.explode(terms).alias("term", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    top = F.max(F.abs("value")).over(Window.partitionBy(key))
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), F.asc("term"))
    return each.select(
        key, "term", "value", F.when(top > 0, F.abs("value") / top).otherwise(0.0).alias("width"),
        F.when(F.col("value") < 0, "negative").otherwise("positive").alias("sign"), F.row_number().over(order).alias("place"),
    )


def year_shade(rows: DataFrame, year: str) -> DataFrame:
    """Years from 0 to 1; 0.5 where all are alike or the year is unknown."""
    span = rows.agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    wide = rows.join(F.broadcast(span))  # one row
    share = (F.col(year) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return wide.withColumn("shade", F.when(F.col(year).isNull() | (F.col("_hi") == F.col("_lo")), 0.5).otherwise(share)).drop("_lo", "_hi")


def label_shown(state: Column, score: Column, mode: str = "relevant") -> Column:
    """Whether a node shows its title: hidden, all, or relevant (no candidate, or a score of 0.35 and more)."""
    if mode not in ("hidden", "all", "relevant"):
        raise ValueError(f"unknown label mode {mode}")
    return F.lit(mode == "all") if mode != "relevant" else visible_at(state, score, 0.35)


def unlabelled(papers: DataFrame) -> DataFrame:
    return papers.where("label is null")


def with_label(papers: DataFrame, label: str) -> DataFrame:
    return papers.where(F.col("label") == label)


def by_doi(papers: DataFrame, dois: DataFrame) -> DataFrame:
    """Papers whose DOI is asked for, whatever its case."""
    return papers.withColumn("_doi", F.lower(F.trim("doi"))).join(dois.select(F.lower(F.trim("doi")).alias("_doi")).distinct(), "_doi", "left_semi").drop("_doi")


def ranked_candidates(papers: DataFrame, metrics: DataFrame, seeds: DataFrame, top: int) -> DataFrame:
    """Unlabelled papers by co-citation, PageRank and citations, all falling, ties by id; unknown metrics are 0."""
    own = unlabelled(papers).join(seeds.select("paper_id"), "paper_id", "left_anti").join(metrics, "paper_id", "left")
    own = own.na.fill(0, ["co_citation", "citation_count"]).na.fill(0.0, ["pagerank"])
    return own.orderBy(F.desc("co_citation"), F.desc("pagerank"), F.desc("citation_count"), "paper_id").limit(top)


def indegree_ranking(edges: DataFrame, papers: DataFrame, label: str | None, top: int) -> DataFrame:
    """The most cited papers of a label (all without one)."""
    n = edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("n"))
    own = papers if label is None else with_label(papers, label)
    return n.join(own.select("paper_id"), "paper_id", "left_semi").orderBy(F.desc("n"), "paper_id").limit(top)


def network_scores(edges: DataFrame, seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """The older combined score of candidates (paper_id, similarity, citation_count) with its reasons.

    References shared with seeds are counted for each seed, so one shared with two counts twice.
    """
    own, pairs = seeds.select("paper_id").distinct(), edges.select("citing_id", "cited_id").distinct()
    near = seed_metrics(pairs, seeds).select("paper_id", "cited_by_seeds", "cites_seeds")
    of_seeds = pairs.join(own.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").groupBy("cited_id").agg(F.count("*").alias("_seeds"))
    shared = pairs.join(of_seeds, "cited_id").groupBy(F.col("citing_id").alias("paper_id")).agg(F.sum("_seeds").alias("shared"))
    rows = candidates.join(own, "paper_id", "left_anti").join(near, "paper_id", "left").join(shared, "paper_id", "left")
    rows = rows.na.fill(0, ["cited_by_seeds", "cites_seeds", "shared", "citation_count"]).na.fill(0.0, ["similarity"])
    met, like, cites = F.col("cited_by_seeds") + F.col("cites_seeds"), F.greatest(F.lit(0.0), "similarity"), F.col("citation_count")
    score = scores.legacy_score(met, F.col("shared"), F.col("similarity"), cites)
    said = F.array_compact(F.array(
        F.when(F.col("cited_by_seeds") > 0, F.format_string("cited by %d of your seed papers", "cited_by_seeds")),
        F.when(F.col("cites_seeds") > 0, F.format_string("cites %d of your seed papers", "cites_seeds")),
        F.when(F.col("shared") > 0, F.format_string("shares %d references with your seed papers", "shared")),
        F.when(like > 0.6, F.format_string("high semantic similarity (%.2f)", like)),
        F.when(cites > 500, F.format_string("%d citations", cites)),
    ))
    told = F.when(F.size(said) == 0, F.array(F.lit("indirect link via citation graph"))).otherwise(said)
    return rows.select("paper_id", score.alias("score"), told.alias("reasons"))


def expansion_value(depth: Column, anchor: Column, crawl_state: Column, percentile: Column) -> Column:
    """How much the expansion of a node promises: near anchors, not exhausted, well ranked; planned extension."""
    left = F.when(crawl_state == "EXPANDED", 0.0).when(crawl_state.isin("REFS_DONE", "CITES_DONE"), 0.5).otherwise(1.0)
    return 1.0 / (1 + depth) * (1 + 0.5 * anchor.cast("int")) * left * (0.3 + 0.7 * percentile)


def nudged(vectors: DataFrame, query: str, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> DataFrame:
    """Rocchio: each session's vector moved to the mean of liked and away from that of disliked vectors
    (session_id, state, vector, ``query``); planned extension."""
    each = vectors.select("session_id", "state", F.posexplode("vector").alias("pos", "v"), F.col(query)[F.col("pos")].alias("q"))
    mean = lambda s: F.coalesce(F.avg(F.when(F.col("state") == s, F.col("v").cast("double"))), F.lit(0.0))
    moved = each.groupBy("session_id", "pos").agg((alpha * F.first("q") + beta * mean("LIKED") - gamma * mean("DISLIKED")).alias("m"))
    return moved.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias(query))


def dislike_proximity(edges: DataFrame, disliked: DataFrame) -> DataFrame:
    """The share of a paper's neighbours that are disliked; planned extension."""
    near = neighbours(edges, edges.select(F.col("citing_id").alias("paper_id")).unionByName(edges.select(F.col("cited_id").alias("paper_id"))))
    bad = disliked.select(F.col("paper_id").alias("other"), F.lit(1).alias("_bad")).distinct()
    return near.select("paper_id", "other").distinct().join(bad, "other", "left").groupBy("paper_id").agg(F.avg(F.coalesce("_bad", F.lit(0))).alias("proximity"))


def group_labels(rows: DataFrame, by: str, text: str, top: int) -> DataFrame:
    """The ``top`` words that tell each group from the others, by TF-IDF over groups; planned extension."""
    words = rows.select(by, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    counts = words.groupBy(by, "word").agg(F.count("*").alias("n"))
    held = counts.groupBy("word").agg(F.count("*").alias("groups"))
    size = rows.agg(F.countDistinct(by).alias("_all"))
    weighed = counts.join(held, "word").join(F.broadcast(size)).withColumn("weight", F.col("n") * F.log(F.col("_all") / F.col("groups")))  # one row
    w = Window.partitionBy(by).orderBy(F.desc("weight"), "word")
    return weighed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(by, "word", "weight", "place")


def best_h_index(authors: Column) -> Column:
    """The greatest h-index among a paper's authors, 0 where none is known; planned extension."""
    return F.coalesce(F.array_max(F.transform(authors, lambda a: a["hIndex"])), F.lit(0))
