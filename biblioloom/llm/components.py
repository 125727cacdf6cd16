"""Connected components of a distributed edge list, without collecting any of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import cut

#: Rows of one part of the state (two longs each), and the least number of parts.
PART_ROWS, PARTS = 500_000, 12
#: Labels that hold more than this share of the nodes (at most 64 of them) are joined by broadcast.
HEAVY = 64


def parts(rows: int) -> int:
    """How many parts a table of so many small rows is kept in."""
    return max(PARTS, -(-rows // PART_ROWS))


def tree(members: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold ``members`` (indices) together: a binary heap by their ``order``, so no node gets more than three.

    Each member's parent is a lesser one, so labels that jump to the label of their label are at the root
    after a number of rounds that grows with the logarithm of the depth.
    """
    own = members[np.argsort(order[members], kind="stable")]
    at = np.arange(1, len(own))
    return own[at], own[(at - 1) // 2]


def of_label(rows: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """``rows`` (…, label) with the column of ``values`` (label unique); few labels may hold most of the rows."""
    heavy = rows.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") > total // HEAVY).select("label")
    heavy = F.broadcast(heavy)  # fewer than HEAVY + 1 rows
    few = rows.join(heavy, "label", "left_anti").join(values, "label")
    return few.unionByName(rows.join(F.broadcast(values.join(heavy, "label", "left_semi")), "label"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (x, y) of any orderable type to (node, label): the least node that each one reaches.

    Each round takes the label of a node's label and then the least label among its neighbours, so the
    rounds grow with the logarithm of the longest chain. State is cut once a round, into parts of
    ``PART_ROWS``. ``edges`` are counted first, so they should be a stored table. Rows with a null end are ignored; repeated edges and loops do no harm; no edges, no rows.
    """
    n = parts(2 * edges.count())
    ends = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    both = cut(ends.where("x is not null and y is not null").distinct().coalesce(n))
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")).coalesce(n))
    total = labels.count()
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))  # every label is a node itself
        jumped = of_label(labels, up, total).select("node", F.col("label").alias("old"), F.least("label", "up").alias("label"))
        near = both.join(jumped.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        state = cut(jumped.join(near, "node").select("node", "old", F.least("label", "near").alias("label")).coalesce(n))
        labels = state.select("node", "label")
        if state.where("label < old").isEmpty():
            return labels
