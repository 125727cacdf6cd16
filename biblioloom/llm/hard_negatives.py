"""Operator 12, hard negatives by a dual-tree search of inner products.

Vectors become integers ``floor(256 * x)``. Candidates (all rows) and anchors each get a tree: a binary one by
principal directions and medians, fitted on a bounded sample, routes every row to a leaf; the rows of a leaf are split
on, in the task that holds them, into blocks of bounded size, the leaves of the tree. Every node has a centre and a
radius, an exact maximum over all of its rows, whatever sample the directions come from. For a pair of nodes
the inner products lie within |ca| rc + |cc| ra + ra rc of that of the centres. Pairs of nodes go down from the
roots, by joins with the children of both; a pair whose interval no anchor below needs is dropped with everything under
it. Pairs of blocks that are left are scored exactly, block by block.

What an anchor needs: for its positives the score of the k-th best one found in its home block; for the
negatives of a positive the window of scores, narrowed by the k-th best of the home block. So pruning never loses a row.
The search is exact; where vectors have no clusters it degrades to all anchors against all rows in blocks.

A block of at most ``ROWS`` candidates or ``ANCHORS`` anchors is one row of a table; tasks hold a pair of blocks at a time. A leaf
that very many equal vectors share makes as many blocks as it needs.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; neither do
rows with a component of 2**15 or more in magnitude (scores may not be exact in a double there), nor those of another
length than the vector of the smallest id left. Rows with the anchor's own id are no positives of it; a repeated
anchor is returned again, repeated candidates take a rank each. Fewer positives or negatives than asked for: all of them.
Other columns, whatever their names, are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioloom.llm.common import cut, small_batches
from biblioloom.llm.vector_codes import SCALE, whole_vectors

#: Rows of a block of candidates and of anchors; blocks that a task splits at once; rows that a tree is fitted on.
ROWS, ANCHORS, GROUP, SAMPLE, DEEPEST = 2048, 256, 16, 16_384, 9
#: Levels of the routing tree that one step of the descent goes down.
STEP = 3
LIMIT = float(2**15)
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
NONE = -(2**62)


@dataclass
class Tree:
    """Routing tree in heap order: node k has the children 2k and 2k + 1; ``centres`` of all nodes, ``axes`` and ``cuts`` of the inner ones."""

    depth: int
    axes: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + ((x * self.axes[at]).sum(axis=1) > self.cuts[at])
        return at


def axis(x: np.ndarray) -> np.ndarray:
    """The direction in which ``x`` is widest, by a few power steps from the row that lies furthest out."""
    own = x - x.mean(axis=0)
    v = own[(own * own).sum(axis=1).argmax()]
    for _ in range(4):
        w = own.T @ (own @ v)
        size = np.linalg.norm(w)
        if size == 0:
            break
        v = w / size
    return v


def grow(x: np.ndarray, depth: int) -> Tree:
    size = x.shape[1]
    axes, cuts, centres = np.zeros((1 << depth, size)), np.zeros(1 << depth), np.zeros((2 << depth, size))
    members = {1: x}
    for node in range(1, 2 << depth):
        own = members.pop(node)
        centres[node] = own.mean(axis=0) if len(own) else centres[node // 2]
        if node < 1 << depth:
            if len(own):
                axes[node] = axis(own)
                cuts[node] = np.median(own @ axes[node])
            high = own @ axes[node] > cuts[node]
            members[2 * node], members[2 * node + 1] = own[~high], own[high]
    return Tree(depth, axes, cuts, centres)


def fit(rows: DataFrame, count: int, block: int) -> Tree:
    """A tree for ``count`` rows with about ``block`` in each leaf, fitted on at most ``SAMPLE`` rows chosen by a hash of their id."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "_x").limit(SAMPLE).select("_x").toArrow()
    x = matrix(some.column(0).combine_chunks()).astype(float)
    depth = max(0, min(math.ceil(math.log2(max(1, count / block))), int(math.log2(max(1, len(x) / 32))), DEEPEST))
    return grow(x, depth)


def split(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of ``x`` in parts of at most ``most`` rows, by halves along the widest direction."""
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            done.append(own)
            continue
        order = np.argsort(x[own] @ axis(x[own]), kind="stable")
        half = len(own) // 2
        todo += [own[order[half:]], own[order[:half]]]
    return done


BLOCK = "node long, home long, n int, centre array<double>, radius double, around array<double>, labels array<long>, ids binary, kinds binary, x binary"


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def blocks(rows: DataFrame, tree: Tree, other: Tree, most: int, count: int) -> DataFrame:
    """``rows`` (vec_id, label, _x) as blocks of at most ``most``, stored; ``home`` is the leaf of ``other`` that a block's centre falls into."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaves(matrix(b.column("_x")).astype(float)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["vec_id", "label", "_x", "leaf"])

    def block(leaf: int, ids: np.ndarray, kinds: np.ndarray, x: np.ndarray) -> dict:
        far = lambda c: float(np.sqrt(((x - c) ** 2).sum(axis=1).max())) + 1e-6
        centre = x.mean(axis=0)
        around = [far(tree.centres[leaf >> up]) for up in range(tree.depth, -1, -1)]
        return {
            "node": leaf, "home": int(other.leaves(centre[None])[0]), "n": len(x), "centre": centre.tolist(), "radius": far(centre), "around": around,
            "labels": np.unique(kinds).tolist(), "ids": ids.astype(np.int64).tobytes(), "kinds": kinds.astype(np.int64).tobytes(), "x": x.astype(np.int32).tobytes(),
        }

    schema = pa.schema([
        ("node", pa.int64()), ("home", pa.int64()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("around", pa.list_(pa.float64())),
        ("labels", pa.list_(pa.int64())), ("ids", pa.binary()), ("kinds", pa.binary()), ("x", pa.binary()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf; up to ``GROUP`` blocks of a leaf are split at once."""
        held: list[tuple] = []

        def flush():
            leaf = int(held[0][0][0])
            ids, kinds, x = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            held.clear()
            parts = [block(leaf, ids[p], kinds[p], x[p]) for p in split(x, most)]
            return pa.RecordBatch.from_pylist(parts, schema)

        for b in batches:
            if not b.num_rows:
                continue
            leaf, ids, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "vec_id", "label"))
            x = matrix(b.column("_x")).astype(float)
            edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for s, e in zip(edges, edges[1:], strict=False):
                if held and (held[0][0][0] != leaf[s] or sum(len(h[0]) for h in held) + e - s > GROUP * most):
                    yield flush()
                held.append((leaf[s:e], ids[s:e], kinds[s:e], x[s:e]))
        if held:
            yield flush()

    routed = rows.mapInArrow(route, "vec_id long, label long, _x array<int>, leaf long")
    order = ["leaf", F.xxhash64("vec_id"), "vec_id"]
    dealt = routed.repartitionByRange(max(1, math.ceil(count / (4 * most))), *order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(pack, BLOCK).withColumn("block", F.monotonically_increasing_id()))


def children(own: DataFrame, tree: Tree, extra: dict[str, Column], total: dict[str, Column]) -> list[DataFrame]:
    """For each step of the descent (parent, node, centre, radius, …): inner nodes, then blocks (as ``-1 - block``).

    ``extra`` are columns of a block, ``total`` their aggregates for the nodes above.
    """
    spark = own.sparkSession
    own = own.withColumns(extra)
    levels = [*range(0, tree.depth, STEP), tree.depth]
    out = []
    for up, d in zip(levels, levels[1:], strict=False):
        nodes = spark.createDataFrame([(k, tree.centres[k].tolist()) for k in range(1 << d, 2 << d)], "node long, centre array<double>")  # at most 512
        node = F.shiftright("node", tree.depth - d)
        found = own.groupBy(node.alias("node")).agg(F.max(F.get("around", F.lit(d))).alias("radius"), *[c.alias(n) for n, c in total.items()])
        found = found.join(F.broadcast(nodes), "node")
        out.append(found.select(F.shiftright("node", d - up).alias("parent"), "node", "centre", "radius", F.lit(None).cast("array<long>").alias("labels"), *total))
    leaf = own.select(F.col("node").alias("parent"), (-1 - F.col("block")).alias("node"), "centre", "radius", "labels", *total)
    return [*out, leaf]


def descend(anchors: list[DataFrame], candidates: list[DataFrame], same: bool) -> DataFrame:
    """(a, c): the pairs of blocks whose interval of inner products some anchor needs; ``same``: search among equal labels, else among others."""
    spark = anchors[0].sparkSession
    pairs = spark.createDataFrame([(1, 1)], "a long, c long")
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    for k in range(max(len(anchors), len(candidates))):
        for name, side in (("a", anchors), ("c", candidates)):
            if k < len(side):
                below = side[k].select(F.col("parent").alias(name), F.struct(*[x for x in side[k].columns if x != "parent"], norm(F.col("centre")).alias("norm")).alias(f"_{name}"))
                pairs = pairs.drop(f"_{name}").join(below, name).withColumn(name, F.col(f"_{name}.node"))
        a, c = F.col("_a"), F.col("_c")
        middle = F.aggregate(F.zip_with(a["centre"], c["centre"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        reach = (a["norm"] * c["radius"] + c["norm"] * a["radius"] + a["radius"] * c["radius"]) * (1 + 1e-9) + 1e-3
        needed = (middle + reach >= a["least"]) & (middle - reach <= a["most"])
        blocks_met = a["labels"].isNotNull() & c["labels"].isNotNull()
        fits = F.arrays_overlap(a["labels"], c["labels"]) if same else (F.size(F.array_union(a["labels"], c["labels"])) > 1)
        pairs = pairs.where(needed & F.when(blocks_met, fits).otherwise(F.lit(True)))
    return pairs.select((-1 - F.col("a")).alias("a"), (-1 - F.col("c")).alias("c"))


def first(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each group by falling score, then rising id."""
    order = np.lexsort((ids, -scores, group))
    own = group[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[rank < k]


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integers below 2**23: at most 128 dimensions are summed in doubles at a time."""
    out = np.zeros((len(a), len(c)), np.int64)
    for s in range(0, a.shape[1], 128):
        out += (a[:, s : s + 128].astype(float) @ c[:, s : s + 128].astype(float).T).astype(np.int64)
    return out


FOUND = "a long, i int, k int, anchor_id long, positive_id long, positive_score long, other long, score long"


def score(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, wanted: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each pair of blocks for each wish (a, wishes): anchor ``i`` of block ``a`` wants scores from ``lo`` to ``hi``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name, kind: np.frombuffer(b.column(name)[r].as_buffer(), kind)  # noqa: B023, E731
                ids, kinds, others, theirs = get("a_ids", np.int64), get("a_kinds", np.int64), get("c_ids", np.int64), get("c_kinds", np.int64)
                x, y = get("a_x", np.int32).reshape(len(ids), -1), get("c_x", np.int32).reshape(len(others), -1)
                wishes = b.column("wishes")[r].values
                w = {f: wishes.field(f).to_numpy(zero_copy_only=False) for f in ("i", "k", "positive_id", "positive_score", "lo", "hi")}
                found = products(x, y)[w["i"]]
                fits = (found >= w["lo"][:, None]) & (found <= w["hi"][:, None])
                kind = kinds[w["i"]][:, None]
                fits &= (theirs == kind) & (others != ids[w["i"]][:, None]) if same else theirs != kind
                at, other = np.nonzero(fits)
                own = first(at, found[at, other], others[other], k)
                at, other = at[own], other[own]
                values = [np.full(len(at), b.column("a")[r].as_py(), np.int64), w["i"][at], w["k"][at], ids[w["i"][at]], w["positive_id"][at], w["positive_score"][at], others[other], found[at, other]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["a", "i", "k", "anchor_id", "positive_id", "positive_score", "other", "score"])

    side = lambda own, name: own.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "kinds", "x")])
    met = pairs.join(side(anchors, "a").join(wanted, "a"), "a").join(side(candidates, "c"), "c").drop("c")
    found = met.mapInArrow(run, FOUND)
    place = F.row_number().over(Window.partitionBy("a", "i", "k").orderBy(F.desc("score"), F.asc("other")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def wishes(rows: DataFrame) -> DataFrame:
    """(a, wishes) from a row for each wish; a block has at most ``ANCHORS`` anchors with ``POSITIVES`` wishes each."""
    fields = ["i", "k", "positive_id", "positive_score", "lo", "hi"]
    return rows.groupBy("a").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("wishes"))


def narrowed(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Wishes with ``lo`` raised to the k-th best score that is known already."""
    known = found.where(F.col("rank") == k).select("a", "i", "k", F.col("score").alias("_best"))
    return rows.join(known, ["a", "i", "k"], "left").withColumn("lo", F.greatest("lo", F.coalesce("_best", F.lit(NONE)))).drop("_best")


def hundredth(x: Column) -> Column:
    """``floor(x / 100)`` of a long, without rounding."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows whose id is divisible by ``every``.

    ``embeddings`` (vec_id, label, embedding). Negatives score between ``low`` and ``high`` per cent of the positive.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = whole_vectors(embeddings, parts=1, limit=LIMIT).where("vec_id is not null and label is not null")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("_x", lambda v: F.floor(v * SCALE).cast("int")).alias("_x"))
    head = rows.orderBy("vec_id", "_x").limit(1).collect()
    result = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not head:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.size("_x") == len(head[0]["_x"]))
    own = rows.where(F.col("vec_id") % every == 0)
    count, asked = rows.count(), own.count()
    if not asked:
        return mine(embeddings.limit(0))
    tree, top = fit(rows, count, ROWS), fit(own, asked, ANCHORS)
    candidates, anchors = blocks(rows, tree, top, ROWS, count), blocks(own, top, tree, ANCHORS, asked)
    below = children(candidates, tree, {}, {})
    home = candidates.groupBy(F.col("node").alias("home")).agg(F.min("block").alias("c"))
    seeds = anchors.join(home, "home").select(F.col("block").alias("a"), "c")

    def search(wanted: DataFrame, same: bool, k: int) -> DataFrame:
        narrow = cut(narrowed(wanted, score(seeds, anchors, candidates, wishes(wanted), same, k), k))
        bounds = narrow.groupBy(F.col("a").alias("block")).agg(F.min("lo").cast("double").alias("least"), F.max("hi").cast("double").alias("most"))
        above = children(anchors.join(bounds, "block"), top, {}, {"least": F.min("least"), "most": F.max("most")})
        return score(descend(above, below, same), anchors, candidates, wishes(narrow), same, k)

    each = anchors.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    none = F.lit(0).cast("long")
    wanted = each.select("a", "i", F.lit(0).alias("k"), none.alias("positive_id"), none.alias("positive_score"), F.lit(NONE).cast("long").alias("lo"), F.lit(-NONE).cast("long").alias("hi"))
    near = search(wanted, True, positives)
    windows = near.select(
        "a", "i", F.col("rank").alias("k"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"),
        (-hundredth(-low * F.col("score"))).alias("lo"), hundredth(high * F.col("score")).alias("hi"),
    )
    found = search(cut(windows.where("lo <= hi")), False, negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).select(result)


def oracle_sql(every: int = 100) -> str:
    """The same rows for DuckDB, all anchors against all rows."""
    return f"""
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {LIMIT})) = len(embedding)),
anchors AS (SELECT * FROM fine WHERE vec_id % {every} = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM anchors a JOIN fine b ON a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
