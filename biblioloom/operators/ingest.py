"""Storing neighbours before they are judged, seeds, quotas of expansion, label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioloom.config import Policy
from biblioloom.operators import filters
from biblioloom.operators.lineage import cut, join_hot, numbered


def ingest(records: DataFrame, policy: Policy, as_of: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbour records (center, direction, paper columns) to papers, edges and decisions.

    Every paper and edge is stored, whatever the verdict; self citations are skipped; what is not
    accepted stays a boundary paper, which has no node.
    """
    real = records.where("center <> paper_id")
    back = F.col("direction") == "BACKWARD"
    edges = real.select(
        F.when(back, F.col("center")).otherwise(F.col("paper_id")).alias("citing_id"),
        F.when(back, F.col("paper_id")).otherwise(F.col("center")).alias("cited_id"),
    ).distinct()
    papers = real.drop("center", "direction").dropDuplicates(["paper_id"])
    judged = filters.cascade(papers, policy, as_of)
    return papers, edges, judged.select("paper_id", "verdict.*")


def boundary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy((F.col("outcome") == "ACCEPT").alias("admitted")).agg(F.count("*").alias("n"))


def add_seeds(papers: DataFrame, policy: Policy, as_of: int, force: bool) -> DataFrame:
    """SEED_ADDED events of accepted papers, and of all with ``force``, which the payload then tells."""
    judged = filters.cascade(papers, policy, as_of)
    ok = F.col("verdict.outcome") == "ACCEPT"
    rows = judged if force else judged.where(ok)
    return rows.select("paper_id", F.lit("SEED_ADDED").alias("event_type"), F.when(ok, F.lit(None).cast("string")).otherwise(F.col("verdict.reason")).alias("forced_over"))


def equal_quota(counts: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """(node, taken): each node gets an equal share of what is left; smaller nodes pass theirs on."""
    out, left = [], budget
    order = sorted(counts, key=lambda c: (c[1], c[0]))
    for i, (node, n) in enumerate(order):
        take = min(n, left // (len(order) - i))
        out.append((node, take))
        left -= take
    return out


def quota(citations: DataFrame, budget: int) -> DataFrame:
    """``equal_quota`` for each session over (session_id, paper_id, n), without bringing a session together.

    In the order of n, anchors are taken whole as long as n is no more than an equal share of what is left; from
    the first that has more, all get that share, and the last ones one more where it does not come out even. So
    places, sums of the smaller ones and that first place of each session say everything.
    """
    rows = citations.select("session_id", "paper_id", F.col("n").cast("long").alias("n"))
    placed = cut(numbered(rows, ["session_id", "n", "paper_id"], "i", total="n"))
    count = placed.count()
    starts = placed.groupBy("session_id").agg((F.min("i")).alias("_i"), F.min("n_before").alias("_n"), F.count("*").alias("c"))
    own = join_hot(placed, starts, "session_id", count)
    own = cut(own.select("session_id", "paper_id", "n", "c", (F.col("i") - F.col("_i")).alias("i"), (F.lit(budget) - (F.col("n_before") - F.col("_n"))).alias("left")))
    share = F.call_function("div", F.col("left"), F.col("c") - F.col("i"))
    first = own.where(F.col("n") > share).groupBy("session_id").agg(F.min(F.struct("i", "left")).alias("_f"))
    bounds = own.select("session_id").distinct().join(first, "session_id", "left").select("session_id", F.col("_f.i").alias("_s"), F.col("_f.left").alias("_l"))
    found = join_hot(own, bounds, "session_id", count)
    rest = F.col("c") - F.col("_s")
    even = F.call_function("div", F.col("_l"), rest) + (F.col("i") - F.col("_s") >= rest - F.pmod(F.col("_l"), rest)).cast("long")
    taken = F.when(F.col("_s").isNull() | (F.col("i") < F.col("_s")), F.col("n")).otherwise(even)
    return found.select(F.col("session_id").cast("long").alias("session_id"), F.col("paper_id").cast("long").alias("paper_id"), taken.alias("taken"))


def labels_table(rows: DataFrame, protected: tuple = ("seed",)) -> DataFrame:
    """The latest label of each paper; a protected one is never overwritten."""
    w = Window.partitionBy("paper_id")
    held = F.max(F.col("label").isin(*protected)).over(w)
    last = F.row_number().over(w.orderBy(F.desc(F.col("label").isin(*protected)), F.desc("seq")))
    return rows.withColumn("_held", held).withColumn("_n", last).where("_n = 1").select("paper_id", "label")


def without_label(papers: DataFrame, label: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers without those of a label, and the edges that have both ends left."""
    gone = papers.where(F.col("label") == label).select("paper_id")
    left = papers.where(~F.col("label").eqNullSafe(F.lit(label)))
    one = edges.join(gone.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_anti")
    return left, one.join(gone.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_anti").select(edges.columns)


def log_seeds(log: DataFrame, titles: DataFrame) -> DataFrame:
    """The log of seed titles (title, first_seen_at) with new ones; a title keeps the time it was first seen."""
    return log.unionByName(titles).groupBy("title").agg(F.min("first_seen_at").alias("first_seen_at"))
