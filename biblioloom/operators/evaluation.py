"""Retrieval metrics, baselines, temporal cutoff and benchmark cases."""

from __future__ import annotations

import pickle
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioloom.functions.dates import latest, visible
from biblioloom.operators.lineage import cut, ranked_within, written

RESAMPLES, SEED, BLOCKS = 1000, 20260916, 10
#: Names of runs that are sent to every task at most.
FEW_RUNS = 10_000
MIN_REFERENCES, SEEDS = 15, 3
#: Rows of a case that one task scores whole, rows of a part of wider cases, and scores held at once.
WIDE, PART, CELLS = 100_000, 50_000, 1 << 20
SUMS = ("recall", "hit", "rr", "ndcg", "cases")


def unique_ranking(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """The first ``k`` results of each case (all without ``k``), repeats collapsed to their first place.

    The list is cut before repeats collapse, so a repeat within it takes a place and brings nothing new.
    ``rank`` counts anew, ``first`` is the place in the list as it came.
    """
    head = ranked if k is None else ranked.where(F.col("rank") <= k)
    first = head.groupBy("case_id", "paper_id").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("case_id").orderBy("first", "paper_id")
    return first.select("case_id", "paper_id", F.row_number().over(w).alias("rank"), "first")


def _ideal(k: int):
    """The greatest discounted gain at k of a case of ``n_true`` true papers."""
    return F.aggregate(F.sequence(F.lit(1), F.least("n_true", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall, hit and NDCG at k and the reciprocal rank of every case of ``truth``.

    The reciprocal rank is that of the first true paper in the whole list as it came; NDCG counts
    places after repeats collapsed.
    """
    true = truth.select("case_id", "paper_id", F.lit(None).cast(ranked.schema["rank"].dataType).alias("rank"), F.lit(True).alias("_true"))
    # each paper of a case goes through one shuffle, with its first place, and meets the truth there
    rows = ranked.select("case_id", "paper_id", "rank", F.lit(False).alias("_true")).unionByName(true)
    marked = rows.groupBy("case_id", "paper_id").agg(F.min("rank").alias("first"), F.max("_true").alias("_true"))
    marked = marked.withColumn("_hit", F.col("_true") & F.expr("first is not null and case_id is not null and paper_id is not null"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("first", "paper_id"))
    got = marked.where(F.col("first") <= k).withColumn("rank", place).where("_hit").groupBy("case_id")
    got = got.agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    size = marked.where("_true").groupBy("case_id").agg(F.count("*").alias("n_true"), F.min(F.when(F.col("_hit"), F.col("first"))).alias("best"))
    ideal = _ideal(k)
    return size.join(got, "case_id", "left").select(
        "case_id",
        (F.coalesce("found", F.lit(0)) / F.col("n_true")).alias("recall"),
        (F.coalesce("found", F.lit(0)) > 0).cast("int").alias("hit"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def resampled_means(values: np.ndarray, first: int, count: int, seed: int = SEED) -> np.ndarray:
    """Means of the resamples from ``first`` on, as ``random.Random(seed).choices`` draws them one after the other."""
    return _resampled([values], first, count, seed)[0]


def _resampled(columns: list[np.ndarray], first: int, count: int, seed: int = SEED) -> np.ndarray:
    """The same for columns of equal length, which share their draws.

    numpy's generator takes over the state of Python's; the draws before ``first`` are passed over.
    """
    *words, at = random.Random(seed).getstate()[1]
    stream, n = np.random.RandomState(), len(columns[0])
    stream.set_state(("MT19937", np.array(words, np.uint32), at))
    for _ in range(first):
        stream.random_sample(n)
    drawn = ((stream.random_sample(n) * n).astype(np.int64) for _ in range(count))
    return np.array([[v[own].mean() for v in columns] for own in drawn]).reshape(count, len(columns)).T


def bounds(resamples: int = RESAMPLES, level: float = 0.95) -> tuple[int, int]:
    """Places (from 0) of an interval's ends among the sorted means."""
    cut_off = (1 - level) / 2
    return int(cut_off * resamples), min(int((1 - cut_off) * resamples), resamples - 1)


def interval(values: list[float], resamples: int = RESAMPLES, seed: int = SEED, level: float = 0.95) -> tuple[float, float]:
    """Percentile bootstrap of the mean of a few values; (0, 0) for none."""
    if not values:
        return (0.0, 0.0)
    means = np.sort(resampled_means(np.array(values, float), 0, resamples, seed))
    low, high = bounds(resamples, level)
    return float(means[low]), float(means[high])


def bootstrap(scored: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The interval of each group, its values in ``order``; a group is one evaluation run, as many values as it has cases."""
    return bootstraps(scored, by, [value], order).drop("metric")


def bootstraps(scored: DataFrame, by: str, values: list[str], order: str) -> DataFrame:
    """(by, metric, mean, low, high) for each group and column of ``values``, which go through shuffles and draws together.

    A task draws ``RESAMPLES / BLOCKS`` of a group's resamples. It holds the group's values (8 bytes a case and column): a run
    of ten million cases needs 80 MB a column in each of its tasks, and its draws take ten seconds a thousand million. As all tasks of a
    group get all of its values, these travel packed, many cases to a row.
    """
    kind, each = scored.schema[by].dataType.simpleString(), RESAMPLES // BLOCKS

    def pack(batches):
        for pdf in batches:
            pdf = pdf.sort_values(order)
            for _, rows in pdf.groupby(by, dropna=False, sort=False):
                packed = zlib.compress(pickle.dumps((rows[order].to_numpy(), *[rows[v].to_numpy(float) for v in values])), 6)
                yield pd.DataFrame({by: [rows[by].iloc[0]], "_packed": [packed]})

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        at, *own = [np.concatenate(x) for x in zip(*[pickle.loads(zlib.decompress(x)) for x in pdf["_packed"]], strict=True)]
        sort = pd.Series(at).sort_values(kind="stable").index.to_numpy()
        own = [v[sort] for v in own]
        means = _resampled(own, int(pdf["_block"].iloc[0]) * each, each)
        return pd.concat([pd.DataFrame({by: [pdf[by].iloc[0]] * each, "metric": v, "mean": x.mean(), "drawn": m}) for v, x, m in zip(values, own, means, strict=True)])

    packed = scored.select(by, *values, order).mapInPandas(pack, f"{by} {kind}, _packed binary")
    rows = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    means = rows.groupBy(by, "_block").applyInPandas(draw, f"{by} {kind}, metric string, mean double, drawn double")
    low, high = bounds(each * BLOCKS)
    ends = means.groupBy(by, "metric").agg(F.first("mean").alias("mean"), F.sort_array(F.collect_list("drawn")).alias("_m"))  # RESAMPLES numbers a group
    return ends.select(by, "metric", "mean", F.get("_m", F.lit(low)).alias("low"), F.get("_m", F.lit(high)).alias("high"))


def baseline(candidates: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """Ranks of a case's candidates by falling key, ties by id; an unknown key counts as 0. A case may have any number of candidates,
    which ``size`` names a column for."""
    rows = candidates.select("case_id", "paper_id", F.coalesce(key, F.lit(0)).alias("_key"))
    ranked = ranked_within(rows, "case_id", [F.desc("_key"), F.asc("paper_id")], "rank", size)
    return ranked.select("case_id", "paper_id", F.col("rank").cast("int").alias("rank"), *([] if size is None else [size]))


def random_baseline(candidates: DataFrame, seed: int = SEED) -> DataFrame:
    """A shuffle of the sorted ids of each case by Python's generator."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["paper_id"].tolist())
        random.Random(seed).shuffle(ids)
        return pd.DataFrame({"case_id": pdf["case_id"].iloc[0], "paper_id": ids, "rank": range(1, len(ids) + 1)})

    return candidates.select("case_id", "paper_id").groupBy("case_id").applyInPandas(run, "case_id long, paper_id long, rank int")


def enforce_cutoff(candidates: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Only candidates that are surely out by the case's cutoff."""
    return candidates.where(visible(F.col(date), F.col(cutoff)))


def eligible_targets(edges: DataFrame, papers: DataFrame, low: int, high: int, least: int, limit: int | None) -> DataFrame:
    """Papers of the years ``low`` to ``high`` with at least ``least`` references; the first ``limit`` by id, or all."""
    refs = edges.groupBy(F.col("citing_id").alias("paper_id")).agg(F.countDistinct("cited_id").alias("n_refs")).where(F.col("n_refs") >= least)
    found = refs.join(papers.where(F.col("year").between(low, high)).select("paper_id", "year"), "paper_id")
    return found if limit is None else found.orderBy("paper_id").limit(limit)


def make_cases(targets: DataFrame, references: DataFrame, least: int = MIN_REFERENCES, seeds: int = SEEDS, seed: int = SEED) -> DataFrame:
    """(case_id, seed_ids, truth_ids, cutoff) from ``references`` (citing_id, cited_id, date).

    Seeds are drawn from each target's sorted references, the rest is the truth. The cutoff is the latest
    day that a seed's partial date may mean; a case whose seeds have no date is left out.
    """
    refs = references.join(targets.select(F.col("paper_id").alias("citing_id")), "citing_id", "left_semi").where("citing_id <> cited_id")
    refs = refs.groupBy("citing_id", "cited_id").agg(F.min(latest(F.col("date"))).cast("string").alias("day"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        days, case = dict(zip(pdf["cited_id"].tolist(), pdf["day"].tolist(), strict=True)), int(pdf["citing_id"].iloc[0])
        ids, none = sorted(days), pd.DataFrame(columns=["case_id", "seed_ids", "truth_ids", "cutoff"])
        if len(ids) < least:
            return none
        chosen = sorted(random.Random(seed + case).sample(ids, seeds))
        known = [days[i] for i in chosen if days[i]]
        if not known:
            return none
        return pd.DataFrame([(case, chosen, [i for i in ids if i not in chosen], max(known))], columns=none.columns)

    return refs.groupBy("citing_id").applyInPandas(run, "case_id long, seed_ids array<long>, truth_ids array<long>, cutoff string")


def dated_references(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Each reference with its publication date, else its year (partial dates)."""
    dates = papers.select(F.col("paper_id").alias("cited_id"), F.coalesce("publication_date", F.col("year").cast("string")).alias("date"))
    return edges.select("citing_id", "cited_id").join(dates, "cited_id")


def per_year_baseline(candidates: DataFrame, as_of: str) -> DataFrame:
    """Ranks by citations a year up to the case's ``as_of`` year; an unknown year ranks by the citations as they are."""
    rate = F.when(F.col("year").isNull(), F.col("citation_count").cast("double")).otherwise(F.col("citation_count") / F.greatest(F.lit(1), F.col(as_of) - F.col("year") + 1))
    return baseline(candidates.withColumn("_rate", rate), "_rate")


def bfs_baseline(candidates: DataFrame) -> DataFrame:
    """Unranked expansion: candidates by the level at which they were met, then by id."""
    rows = candidates.select("case_id", "paper_id", "level")
    return ranked_within(rows, "case_id", ["level", "paper_id"], "rank").select("case_id", "paper_id", F.col("rank").cast("int").alias("rank"))


def evaluate(runs: DataFrame, truth: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """Mean metrics with bootstrap intervals of each run of ``runs`` (run, case_id, paper_id, rank).

    Where the caller knows the ``names`` of all runs, ``runs`` are not computed once more to find them.
    """
    named = runs.withColumn("_case", F.struct("run", "case_id"))
    if names is None:
        listed = cut(runs.select("run").distinct())
    else:
        listed = runs.sparkSession.createDataFrame([(x,) for x in names], runs.select("run").schema)
    cases = truth.select("case_id", "paper_id").join(F.broadcast(listed) if listed.count() <= FEW_RUNS else listed)
    scored = metrics(
        named.select(F.col("_case").alias("case_id"), "paper_id", "rank"),
        cases.select(F.struct("run", "case_id").alias("case_id"), "paper_id"), k,
    )
    names = ["recall", "hit", "rr", "ndcg"]
    each = scored.select("case_id.run", F.col("case_id.case_id").alias("case_id"), *[F.col(m).cast("double").alias(m) for m in names])
    return bootstraps(each, "run", names, "case_id")


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of several rankings (paper_id, rank); planned extension."""
    return rankings.groupBy("paper_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"))


class _Sweep:
    """Scores and ranks of whole blocks of candidates for all weight configurations at once (rows sorted by case, id, truth)."""

    def __init__(self, grid: list[dict[str, float]], k: int):
        self.names = sorted({n for w in grid for n in w})
        self.weights = np.array([[float(w.get(n, 0.0)) for n in self.names] for w in grid]).reshape(len(grid), len(self.names))
        self.k, self.discount = k, 1 / np.log2(np.arange(k) + 2.0)

    def scores(self, features: np.ndarray, runs: slice = slice(None)) -> np.ndarray:
        """runs x the shape of the rows, whose features come last; summed in the order of names."""
        out = np.zeros((len(self.weights[runs]), *features.shape[:-1]))
        for j in range(len(self.names)):
            out += self.weights[runs, j].reshape(-1, *[1] * (features.ndim - 1)) * features[..., j]
        return out

    def order(self, scores: np.ndarray) -> np.ndarray:
        """Falling scores along the last axis, equal ones as they come; NaN counts as the greatest, as in Spark."""
        return np.argsort(np.where(np.isnan(scores), -np.inf, -scores), axis=-1, kind="stable")

    @staticmethod
    def marked(case: np.ndarray, paper: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are true candidates, and which are the first row of a true paper."""
        same = (case[1:] == case[:-1]) & (paper[1:] == paper[:-1])
        return ~truth & np.append(same & truth[1:], False), truth & ~np.append(False, same & truth[:-1])

    def sums(self, case: np.ndarray, paper: np.ndarray, truth: np.ndarray, features: np.ndarray, into: np.ndarray) -> None:
        """Adds recall, hit, reciprocal rank, NDCG and the number of whole cases to ``into`` (runs x 5)."""
        if not len(case):
            return
        hit, first = self.marked(case, paper, truth)
        start = np.flatnonzero(np.append(True, case[1:] != case[:-1]))
        n_true, n_hit = np.add.reduceat(first, start, dtype=np.int64), np.add.reduceat(hit, start, dtype=np.int64)
        into[:, 4] += (n_true > 0).sum()
        rows = np.flatnonzero(~truth)
        n = np.add.reduceat(~truth, start, dtype=np.int64)
        at = np.cumsum(n) - n
        ideal = np.cumsum(self.discount)
        wide = np.where(n <= 64, -(-n // 8) * 8, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        for m in np.unique(wide[n_hit > 0]):
            cases = np.flatnonzero((wide == m) & (n_hit > 0))
            runs = max(1, min(len(self.weights), CELLS // int(m)))
            some = max(1, CELLS // int(m * runs))
            for c in (cases[i : i + some] for i in range(0, len(cases), some)):
                inside = np.arange(m) < n[c, None]
                own = rows[np.where(inside, at[c, None] + np.arange(m), at[c, None])]
                true, values = hit[own] & inside, features[own]
                for r in range(0, len(self.weights), runs):
                    scores = np.where(inside, self.scores(values, slice(r, r + runs)), -np.inf)  # what fills up comes last
                    placed = np.take_along_axis(np.broadcast_to(true, scores.shape), self.order(scores), -1)
                    head = placed[..., : self.k]
                    found = head.sum(axis=-1)
                    dcg = head @ self.discount[: head.shape[-1]]
                    part = into[r : r + runs]
                    part[:, 0] += (found / n_true[c]).sum(axis=-1)
                    part[:, 1] += (found > 0).sum(axis=-1)
                    part[:, 2] += (1.0 / (placed.argmax(axis=-1) + 1)).sum(axis=-1)
                    part[:, 3] += (dcg / ideal[np.minimum(n_true[c], self.k) - 1]).sum(axis=-1)


def sweep_metrics(cases: DataFrame, truth: DataFrame, grid: list[dict[str, float]], k: int) -> DataFrame:
    """(run, recall, hit, rr, ndcg, cases): mean metrics at k of every weight configuration of ``grid``.

    ``cases`` (case_id, paper_id, features) are all candidates, each once for a case, ranked by falling score, ties by id. They are
    shuffled once by case, with their features: a task scores its cases for all configurations and gives one sum for each. Cases of over ``WIDE``
    rows are dealt to parts instead: a part gives its k best rows and its best true one, then counts the rows before
    the best true one of the case. A case of ``truth`` without candidates counts as 0; rows without an id take no part.
    """
    spark, sweep, n_runs = cases.sparkSession, _Sweep(grid, k), len(grid)
    names = [f"f{j}" for j in range(len(sweep.names))]
    ids = [F.col(c).cast("long").alias(c) for c in ("case_id", "paper_id")]
    rows = cases.select(*ids, F.lit(False).alias("truth"), *[F.coalesce(F.try_element_at("features", F.lit(n)).cast("double"), F.lit(0.0)).alias(f) for f, n in zip(names, sweep.names, strict=True)])
    true = truth.select(*ids, F.lit(True).alias("truth"), *[F.lit(0.0).alias(f) for f in names])
    rows, drop = written(rows.unionByName(true).where("case_id is not null and paper_id is not null"))
    wide = cut(rows.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > WIDE).select("case_id", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    block = lambda t: (t["case_id"].to_numpy(), t["paper_id"].to_numpy(), t["truth"].to_numpy(zero_copy_only=False), np.stack([t[f].to_numpy() for f in names], axis=1) if names else np.zeros((t.num_rows, 0)))

    def small(batches):
        into, left = np.zeros((n_runs, 5)), None
        for batch in batches:
            own = block(batch)
            if not len(own[0]):
                continue
            left = own if left is None else tuple(np.concatenate(x) for x in zip(left, own, strict=True))
            if left[0][-1] != left[0][0]:
                cut_at = np.searchsorted(left[0], left[0][-1])  # the last case may go on
                sweep.sums(*[x[:cut_at] for x in left], into)
                left = tuple(x[cut_at:] for x in left)
        if left is not None:
            sweep.sums(*left, into)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_runs, dtype=np.int32)), *[pa.array(x) for x in into.T]], names=["run", *SUMS])

    # as many wide cases as rows / WIDE
    met = rows.join(F.broadcast(wide), "case_id", "left_anti").repartition("case_id").sortWithinPartitions("case_id", "paper_id", "truth")
    summed = met.mapInArrow(small, "run int, " + ", ".join(f"{c} double" for c in SUMS))
    if not wide.isEmpty():
        summed = summed.unionByName(_wide_sums(rows.join(F.broadcast(wide), "case_id"), wide, sweep, names))
    whole = cut(summed.groupBy("run").agg(*[F.sum(c).alias(c) for c in SUMS]).where("cases > 0"))
    drop()
    return whole.select("run", *[(F.col(c) / F.col("cases")).alias(c) for c in SUMS[:-1]], F.col("cases").cast("long").alias("cases"))


def _wide_sums(rows: DataFrame, wide: DataFrame, sweep: _Sweep, names: list[str]) -> DataFrame:
    """The sums of cases that are dealt to parts of about ``PART`` rows."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("paper_id"), F.col("parts")).cast("int"))
    n_runs, key = len(sweep.weights), ["case_id", "part"]

    def sorted_part(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["paper_id", "truth"])
        case, paper, truth = pdf["case_id"].to_numpy(), pdf["paper_id"].to_numpy(), pdf["truth"].to_numpy(bool)
        hit, first = sweep.marked(case, paper, truth)
        return case[0], paper[~truth], hit[~truth], int(first.sum()), pdf[names].to_numpy(float).reshape(len(pdf), len(names))[~truth]

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        case, paper, hit, n_true, features = sorted_part(pdf)
        out = [pd.DataFrame({"case_id": [case], "run": [-1], "paper_id": [n_true], "score": [0.0], "hit": [False]})]
        for r in range(n_runs if len(paper) else 0):
            score = sweep.scores(features, slice(r, r + 1))[0]
            order = sweep.order(score)
            take = order[: sweep.k]
            if hit.any() and not hit[take].any():
                take = np.append(take, order[hit[order].argmax()])  # behind k rows of its own part, so never among the k best
            out.append(pd.DataFrame({"case_id": case, "run": r, "paper_id": paper[take], "score": score[take], "hit": hit[take]}))
        return pd.concat(out)

    def before(pdf: pd.DataFrame, bests: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or bests.empty:
            return pd.DataFrame({"case_id": [], "run": [], "before": []})
        case, paper, _, _, features = sorted_part(pdf)
        made = []
        for r, top, at in zip(bests["run"], bests["score"], bests["paper_id"], strict=True):
            score = sweep.scores(features, slice(r, r + 1))[0]
            if np.isnan(top):
                ahead = np.isnan(score) & (paper < at)
            else:
                ahead = np.isnan(score) | (score > top) | ((score == top) & (paper < at))
            made.append((case, r, int(ahead.sum())))
        return pd.DataFrame(made, columns=["case_id", "run", "before"])

    told = cut(rows.groupBy(*key).applyInPandas(best, "case_id long, run int, paper_id long, score double, hit boolean"))
    size = told.where("run < 0").groupBy("case_id").agg(F.sum("paper_id").alias("n_true")).where("n_true > 0")
    place = F.row_number().over(Window.partitionBy("run", "case_id").orderBy(F.desc("score"), F.asc("paper_id")))
    top = told.where("run >= 0").withColumn("rank", place).where((F.col("rank") <= sweep.k) & F.col("hit"))
    got = top.groupBy("run", "case_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    first = told.where("hit").groupBy("run", "case_id").agg(F.max(F.struct("score", (-F.col("paper_id")).alias("at"))).alias("_b"))
    first = first.select("case_id", "run", F.col("_b.score").alias("score"), (-F.col("_b.at")).alias("paper_id"))
    dealt = first.join(F.broadcast(wide), "case_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    ahead = rows.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(before, "case_id long, run int, before long")
    ahead = ahead.groupBy("run", "case_id").agg(F.sum("before").alias("before"))
    runs = rows.sparkSession.range(n_runs).select(F.col("id").cast("int").alias("run"))
    each = size.join(F.broadcast(runs)).join(got, ["run", "case_id"], "left").join(ahead, ["run", "case_id"], "left")
    found = F.coalesce("found", F.lit(0))
    return each.groupBy("run").agg(
        F.sum(found / F.col("n_true")).alias("recall"), F.sum((found > 0).cast("double")).alias("hit"),
        F.sum(F.coalesce(1.0 / (F.col("before") + 1), F.lit(0.0))).alias("rr"),
        F.sum(F.coalesce("dcg", F.lit(0.0)) / _ideal(sweep.k)).alias("ndcg"), F.count("*").cast("double").alias("cases"),
    )
