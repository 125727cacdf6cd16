"""Search and duplicate review over a table of vectors (id, vector) by cosine.

The index deals vectors to k-means cells (by angle) and keeps, for each cell, its widest angle. A search scores the
cells nearest to a query first; with ``exact`` it goes on to every cell whose angle bound still allows a better hit than
the k-th found, so the result is that of a full comparison, whatever the cells. Cells are scored in chunks of rows
against blocks of queries, so neither a popular cell nor many queries meet in one task.

Near duplicates are found by angular signatures: keys of signs of random projections, as many as it takes that a pair at the
threshold misses all of them with a probability of one in a million (``keys_for``). Equal vectors are one class, named by
its least id; pairs are between classes. Large groups of a key are compared in parts, part against part.

Vectors that are null, empty, zero or not finite have no direction and take no part; neither do those of another length than
the one of the least id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioloom.functions import text
from biblioloom.operators.lineage import cut

#: Rows of a cell and queries that are scored at once; cells at most; cells that a search probes first.
CHUNK, QUERIES, CELLS, PROBES = 8192, 256, 1024, 8
SEED = 14
#: How seldom a pair at the threshold shares no key, signs of a sketch, rows of a part, groups that are compared at once.
MISS, SKETCH, PART, FEW = 1e-6, 256, 2048, 48
SLACK = 1e-9


def directions(rows: DataFrame, length: int | None = None) -> DataFrame:
    """(id, x): ``rows`` (id, vector) as unit vectors, of ``length`` or else of that of the least id."""
    x = rows.select("id", F.col("vector").cast("array<double>").alias("x"))
    fine = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    x = x.where(F.col("id").isNotNull() & fine).withColumn("_size", size).where("_size > 0 and _size < double('infinity')")
    if length is None:
        head = x.orderBy("id").select(F.size("x")).limit(1).collect()
        length = head[0][0] if head else 0
    return x.where(F.size("x") == length).select("id", F.transform("x", lambda v: v / F.col("_size")).alias("x"))


class Index:
    """Cells of ``rows`` (id, vector): ``cells`` (id, x, cell) is stored, ``centres`` has at most ``CELLS`` rows."""

    def __init__(self, rows: DataFrame, cells: int | None = None, seed: int = SEED):
        own = cut(directions(rows))
        n = own.count()
        k = min(CELLS, n, cells or max(1, math.isqrt(n)))
        if k < 2:
            self.centres = np.zeros((1, 0)) if not n else np.array([own.orderBy("id").first()["x"]])
            dealt = own.withColumn("cell", F.lit(0))
        else:
            fitted = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=8, featuresCol="v", predictionCol="cell").fit(own.select(array_to_vector("x").alias("v")))
            self.centres = np.array(fitted.clusterCenters())
            dealt = fitted.transform(own.withColumn("v", array_to_vector("x"))).drop("v")
        self.centres = self.centres / np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-300)
        centres = self.centres

        @F.pandas_udf("double")
        def angle(x: pd.Series, cell: pd.Series) -> pd.Series:
            own = np.stack(x.to_numpy()) if len(x) else np.zeros((0, centres.shape[1]))
            return pd.Series(np.arccos(np.clip((own * centres[cell.to_numpy()]).sum(axis=1), -1, 1)))

        self.cells = cut(dealt.withColumn("angle", angle("x", "cell")))
        self.widths = self.cells.groupBy("cell").agg(F.max("angle").alias("widest"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))

    def _scored(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, id, cosine): the k best of every asked (query, qx, cell) in each chunk."""
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        sizes = self.widths.join(blocks, "cell")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        side = lambda rows, own, other, key, mine, theirs: rows.join(sizes, "cell").select(
            *rows.columns, F.pmod(F.xxhash64(key), F.col(mine)).cast("int").alias(own), upto(theirs).alias(other)
        )
        left = side(self.cells.select("cell", "id", "x"), "chunk", "block", "id", "chunks", "blocks")
        right = side(asked, "block", "chunk", "query", "blocks", "chunks")

        def score(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or queries.empty:
                return pd.DataFrame({"query": [], "id": [], "cosine": []})
            found = np.stack(queries["qx"].to_numpy()) @ np.stack(rows["x"].to_numpy()).T
            ids, names = rows["id"].to_numpy(), queries["query"].to_numpy()
            found[names[:, None] == ids[None, :]] = -2.0  # a query is no hit of its own
            order = np.argsort(ids, kind="stable")
            best = order[np.argsort(-found[:, order], axis=1, kind="stable")[:, :k]]
            made = pd.DataFrame({"query": np.repeat(names, best.shape[1]), "id": ids[best].ravel(), "cosine": np.take_along_axis(found, best, 1).ravel()})
            return made[made["cosine"] > -1.5]

        key = ["cell", "chunk", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, "query long, id long, cosine double")

    def search(self, queries: DataFrame, k: int, exact: bool = True, probes: int = PROBES) -> DataFrame:
        """(query, rank, id, cosine) of the k nearest rows to each of ``queries`` (id, vector); a row with the query's id is no hit."""
        centres, widest = self.centres, {r["cell"]: r["widest"] for r in self.widths.collect()}  # one row for each cell
        widths = np.array([widest.get(c, -1.0) for c in range(len(centres))])

        def near(frames):
            for pdf in frames:
                if not len(pdf):
                    continue
                angle = np.arccos(np.clip(np.stack(pdf["x"].to_numpy()) @ centres.T, -1, 1))
                angle[:, widths < 0] = np.inf  # empty cells
                bound = np.cos(np.clip(angle - widths[None, :], 0, np.pi))
                place = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
                own, cell = np.nonzero(np.isfinite(angle))
                yield pd.DataFrame({"query": pdf["id"].to_numpy()[own], "qx": pdf["x"].to_numpy()[own], "cell": cell.astype(np.int32), "bound": bound[own, cell], "place": place[own, cell].astype(np.int32)})

        asked = directions(queries, centres.shape[1]).mapInPandas(near, "query long, qx array<double>, cell int, bound double, place int")
        first = cut(_best(self._scored(asked.where(F.col("place") < probes).select("query", "qx", "cell"), k), k))
        if not exact:
            return first
        known = first.where(F.col("rank") == k).select("query", F.col("cosine").alias("least"))
        more = asked.where(F.col("place") >= probes).join(known, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        return _best(first.select("query", "id", "cosine").unionByName(self._scored(more.select("query", "qx", "cell"), k)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), F.asc("id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")


def unreached(found: DataFrame, reached: DataFrame) -> DataFrame:
    """Hits (query, rank, id, cosine) that the citation graph does not give: those not among ``reached`` (paper_id)."""
    return found.join(reached.select(F.col("paper_id").alias("id")).distinct(), "id", "left_anti")


def classes(rows: DataFrame) -> DataFrame:
    """(id, representative): the least id with an equal direction."""
    own = directions(rows)
    least = own.groupBy("x").agg(F.min("id").alias("representative"))
    return own.join(least, "x").select("id", "representative")


def keys_for(n: int, threshold: float) -> tuple[int, int, int]:
    """(signs of a key, keys, differing bits of a sketch at most) for ``n`` vectors: some ten strangers share a key, a pair at ``threshold``
    misses all keys with a probability of ``MISS`` and lies beyond the sketch's limit (6.5 deviations) far less often."""
    differ = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = min(24, max(8, math.ceil(math.log2(max(n, 1))) - 4))
    tables = math.ceil(math.log(MISS) / math.log1p(-max((1 - differ) ** bits, 1e-9))) if differ > 0 else 1
    return bits, tables, math.ceil(SKETCH * differ + 6.5 * math.sqrt(SKETCH * differ * (1 - differ))) + 1


def duplicates(rows: DataFrame, threshold: float = 0.97) -> DataFrame:
    """(a, b, cosine): pairs of classes with a cosine above ``threshold``, a below b.

    Keys travel with a sketch of ``SKETCH`` signs instead of the vector; only pairs whose sketches are close meet their vectors.
    """
    own = cut(directions(rows).groupBy("x").agg(F.min("id").alias("id")))
    n, length = own.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n < 2:
        return own.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine")).limit(0)
    bits, tables, far = keys_for(n, threshold)
    planes = np.random.default_rng(SEED).standard_normal((length, tables * bits + SKETCH))
    words = [f"s{i}" for i in range(SKETCH // 64)]

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 512):
                up = x[i : i + 512] @ planes > 0
                some = len(up)
                keys = (up[:, : tables * bits].reshape(some, tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                sketch = np.packbits(up[:, tables * bits :], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[i : i + 512], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), some)), pa.array(keys.ravel()), *[pa.array(np.repeat(sketch[:, j], tables)) for j in range(len(words))]],
                    names=["id", "which", "bits", *words],
                )

    keyed = own.select("id", "x").mapInArrow(sign, "id long, which int, bits int, " + ", ".join(f"{w} long" for w in words))
    wide = cut(keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("which", "bits", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    # a part of a wide key meets itself and every other part once; there are at most (rows of keys / PART) wide keys
    dealt = keyed.join(F.broadcast(wide), ["which", "bits"], "left") if not wide.isEmpty() else keyed.withColumn("parts", F.lit(1))
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["which", "bits", "low", "high"]
    met = met.select("which", "bits", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "id", *words)

    def near(batches):
        left = None
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(own[0]):
                continue
            left = own if left is None else [np.concatenate(c) for c in zip(left, own, strict=True)]
            last = np.logical_and.reduce([c == c[-1] for c in left[:4]])  # the last group may go on
            cut_at = 0 if last.all() else len(last) - int(last[::-1].argmin())
            if cut_at:
                yield from _close([c[:cut_at] for c in left], far)
                left = [c[cut_at:] for c in left]
        if left is not None:
            yield from _close(left, far)

    candidates = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(near, "a long, b long").distinct()
    side = lambda c: own.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"))

    @F.pandas_udf("double")
    def product(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(u.to_numpy()) * np.stack(v.to_numpy())).sum(axis=1) if len(u) else [], dtype=float)

    return candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", product("xa", "xb").alias("cosine")).where(F.col("cosine") > threshold)


def _close(rows: list[np.ndarray], far: int):
    """Pairs (a, b) of ids, a below b, inside the groups of the first four columns whose sketches differ in ``far`` bits at most."""
    ids, sketch = rows[4], np.stack(rows[5:], axis=1).view(np.uint64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:4]])
    start = np.flatnonzero(np.append(True, new))
    size = np.diff(np.append(start, len(ids)))
    for g in np.unique(size[size > 1]):
        at = start[size == g]
        for d in range(1, g) if g <= FEW else ():  # many small groups at once
            i = (at[:, None] + np.arange(g - d)).ravel()
            yield from _told(ids, i, i + d, np.bitwise_count(sketch[i] ^ sketch[i + d]).sum(axis=1, dtype=np.int32) <= far)
        for s in at if g > FEW else ():
            for i in range(s, s + g, 128):
                own = sketch[i : min(i + 128, s + g)]
                apart = np.bitwise_count(own[:, None, :] ^ sketch[None, i : s + g, :]).sum(axis=2, dtype=np.int32)
                u, v = np.nonzero(apart <= far)
                yield from _told(ids, i + u, i + v, u < v)


def _told(ids: np.ndarray, i: np.ndarray, j: np.ndarray, keep: np.ndarray):
    if keep.any():
        a, b = ids[i[keep]], ids[j[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def review(pairs: DataFrame, papers: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs with both titles and their likeness (1 less the edit distance over the longer one), for a person to judge."""
    side = lambda c: papers.select(F.col("paper_id").alias(c), F.col("title").alias(f"title_{c}"))
    a, b = (text.normalize_title(F.coalesce(F.col(c), F.lit(""))) for c in ("title_a", "title_b"))
    longer = F.greatest(F.length(a), F.length(b))
    alike = F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("title_likeness", alike).where(F.col("title_likeness") >= least)
