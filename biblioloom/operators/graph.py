"""Citation graph operators: induced edges, degrees, coupling, PageRank, components, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.operators.lineage import cut, join_hot


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (paper_id)."""
    keep = nodes.select("paper_id").distinct()
    one = edges.join(keep.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi")
    return one.join(keep.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi").select("citing_id", "cited_id")


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes``, each once; two semi joins rather than one OR."""
    keep = nodes.select("paper_id").distinct()
    out = edges.join(keep.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").select("citing_id", "cited_id")
    into = edges.join(keep.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi").select("citing_id", "cited_id")
    return out.unionByName(into).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, in_degree, out_degree) of all nodes, zero filled, in one shuffle of the edge ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("cited_id").alias("paper_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                                          F.struct(F.col("citing_id").alias("paper_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    own = ends.groupBy("paper_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("paper_id").join(own, "paper_id", "left").na.fill(0, ["in_degree", "out_degree"])


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("citing_id", "cited_id").alias("a"), F.greatest("citing_id", "cited_id").alias("b")).where("a <> b").distinct()


def coupling(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct references that a paper shares with the anchors (anchors left out)."""
    own = anchors.select("paper_id").distinct()
    theirs = edges.join(own.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").select("cited_id").distinct()
    shared = edges.join(theirs, "cited_id", "left_semi")
    others = shared.join(own.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_anti")
    return others.groupBy(F.col("citing_id").alias("paper_id")).agg(F.countDistinct("cited_id").alias("coupled"))


def cocitation(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct papers that cite a paper together with an anchor (anchors left out)."""
    turned = edges.select(F.col("cited_id").alias("citing_id"), F.col("citing_id").alias("cited_id"))
    return coupling(turned, anchors).withColumnRenamed("coupled", "cocited")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85, restart: DataFrame | None = None, tolerance: float | None = None, strict: bool = True) -> DataFrame:
    """(paper_id, rank) after ``rounds`` power steps; dangling mass is dealt like the restart.

    With a ``tolerance`` it stops once a step changes the ranks by less than that for each node (summed
    over all, as networkx does), and fails if ``rounds`` steps are not enough. Links must have both ends
    among the nodes (``induced``).
    ``restart`` (paper_id) makes it personalised. Lineage is cut at every round, so a round reads one
    small table and the links, whatever came before.
    """
    ids = cut(nodes.select("paper_id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    if restart is None:
        base = ids.withColumn("share", F.lit(1.0 / n))
    else:
        some = restart.select("paper_id").distinct().join(ids, "paper_id", "left_semi")
        k = some.count()
        if not k:
            raise ValueError("no restart node is in the graph")
        base = ids.join(some.withColumn("share", F.lit(1.0 / k)), "paper_id", "left").na.fill(0.0, ["share"])
    out = edges.select("citing_id", "cited_id").distinct()
    links = cut(out.join(out.groupBy("citing_id").agg(F.count("*").alias("n_out")), "citing_id"))
    start = base.join(links.select(F.col("citing_id").alias("paper_id")).distinct().withColumn("_out", F.lit(True)), "paper_id", "left")
    ranks = cut(start.select("paper_id", "share", F.col("_out").isNull().alias("dangling"), F.col("share").alias("rank")))
    fixed = ranks.drop("rank")
    for _ in range(rounds):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = (
            links.join(ranks.select(F.col("paper_id").alias("citing_id"), "rank"), "citing_id")
            .groupBy(F.col("cited_id").alias("paper_id"))
            .agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        )
        step = F.lit(1 - damping) * F.col("share") + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("share"))
        if tolerance is None:
            ranks = cut(fixed.join(given, "paper_id", "left").select("paper_id", "share", "dangling", step.alias("rank")))
            continue
        both = fixed.join(given, "paper_id", "left").join(ranks.select("paper_id", F.col("rank").alias("_old")), "paper_id")
        ranks = cut(both.select("paper_id", "share", "dangling", step.alias("rank"), "_old"))
        change = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
        ranks = ranks.drop("_old")
        if change < n * tolerance:
            return ranks.select("paper_id", "rank")
    if tolerance is not None and strict:
        raise ArithmeticError(f"PageRank has not converged in {rounds} steps")
    return ranks.select("paper_id", "rank")


def signals(nodes: DataFrame, edges: DataFrame, floor: float, damping: float = 0.85) -> DataFrame:
    """Degrees of all nodes (paper_id, crawl_state), and PageRank of those that are no stubs, over the edges among
    them, to a tolerance of 1e-6 a node in 100 steps.

    Below the completeness floor ranks are absent (null), not zero; stubs never have one.
    """
    read = nodes.where("crawl_state <> 'STUB'").select("paper_id")
    own = degrees(nodes, induced(edges, nodes))
    if completeness(nodes).first()[0] < floor:
        return own.withColumn("rank", F.lit(None).cast("double"))
    return own.join(pagerank(read, induced(edges, read), 100, damping, tolerance=1e-6), "paper_id", "left")


def plain_pagerank(nodes: DataFrame, edges: DataFrame, steps: int = 200, change: float = 1e-8) -> DataFrame:
    """The fallback formula: up to ``steps`` steps, ended by a change below ``change`` in all; no failure if it is not met."""
    n = max(1, nodes.select("paper_id").distinct().count())
    return pagerank(nodes, induced(edges, nodes), steps, tolerance=change / n, strict=False)


def reachable(edges: DataFrame, kept: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that ``kept`` reach over any number of edges, nodes that go because none does)."""
    met = reach(edges, kept, None).select("paper_id")
    return nodes.join(met, "paper_id", "left_semi"), nodes.join(met, "paper_id", "left_anti")


def completeness(nodes: DataFrame) -> DataFrame:
    """The share of nodes that are no stubs, four decimals; 0 for an empty graph."""
    return nodes.agg(F.coalesce(F.round(F.avg((F.col("crawl_state") != "STUB").cast("double")), 4), F.lit(0.0)).alias("completeness"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, component): the least id reachable; isolated nodes are their own.

    The label of a node's label is looked up by ``join_hot``, as a giant component's label is most nodes' label.
    """
    ids = cut(nodes.select("paper_id").distinct())
    n = ids.count()
    pairs = undirected(induced(edges, ids))
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(ids.select("paper_id", F.col("paper_id").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("paper_id", "b"), "b").groupBy(F.col("a").alias("paper_id")).agg(F.min("component").alias("near"))
        lower = cut(labels.join(near, "paper_id", "left").select("paper_id", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        up = lower.select(F.col("paper_id").alias("component"), F.col("component").alias("up"))
        jumped = cut(join_hot(lower, up, "component", n).select("paper_id", F.least("component", "up").alias("component"), "old"))
        labels = jumped.select("paper_id", "component")
        if jumped.where("component < old").isEmpty():
            return labels


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges, components, average degree and density (four decimals)."""
    n = nodes.select("paper_id").distinct().agg(F.count("*").alias("nodes"))
    e = undirected(induced(edges, nodes)).agg(F.count("*").alias("edges"))
    c = components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    size = F.col("nodes").cast("double")
    return n.join(e).join(c).select(  # three single rows
        "nodes", "edges", "components",
        F.when(F.col("nodes") > 0, F.round(2 * F.col("edges") / size, 4)).otherwise(0.0).alias("avg_degree"),
        F.when(F.col("nodes") > 1, F.round(2 * F.col("edges") / (size * (size - 1)), 4)).otherwise(0.0).alias("density"),
    )


def reach(edges: DataFrame, sources: DataFrame, depth: int | None) -> DataFrame:
    """(paper_id, distance): undirected breadth-first search, to a depth or to the end."""
    pairs = undirected(edges)
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    seen = cut(sources.select("paper_id").distinct().withColumn("distance", F.lit(0)))
    edge, step = seen, 0
    while depth is None or step < depth:
        step += 1
        new = both.join(edge.select(F.col("paper_id").alias("a")), "a", "left_semi").select(F.col("b").alias("paper_id")).distinct()
        edge = cut(new.join(seen, "paper_id", "left_anti").withColumn("distance", F.lit(step)))
        if depth is None and edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def sweep(nodes: DataFrame, edges: DataFrame, held: DataFrame, depth: int) -> DataFrame:
    """Candidates that no anchor reaches within ``depth`` and that no user holds."""
    anchors = nodes.where(F.col("state").isin("SEED", "LIKED"))
    marked = reach(induced(edges, nodes), anchors, depth).select("paper_id")
    return nodes.where("state = 'CANDIDATE'").select("paper_id").join(marked, "paper_id", "left_anti").join(held.select("paper_id"), "paper_id", "left_anti")
