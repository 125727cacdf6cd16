"""Rank percentiles, the feature pass, pooling, allocation and pages of candidates."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioloom.config import Policy
from biblioloom.functions import scores
from biblioloom.operators import filters, graph
from biblioloom.operators.lineage import cut, join_hot, numbered, ranked_within


def rank_percentile(rows: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """Rank among the distinct values of a group, from 0 to 1; a single value is 0.5, null stays null.

    The rank is taken over distinct values only, so the window sees far fewer rows than the table. For a
    ranking without groups see ``percentiles``.
    """
    w = Window.partitionBy(*by)
    distinct = rows.where(F.col(value).isNotNull()).select(*by, value).distinct()
    ranked = distinct.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    share = F.when(F.col("_n") == 1, 0.5).otherwise(F.col("_r") / (F.col("_n") - 1))
    ranked = ranked.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, value]], share.alias(name))
    same = F.lit(True)
    for c in [*by, value]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(ranked, same, "left").drop(*[f"_k_{c}" for c in [*by, value]])


def percentiles(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``rows`` (key unique) with the percentile of each column of ``values`` under its own name with ``_pct``.

    All columns go through one pass: they are unpivoted, their distinct values ranked together by
    sorted parts and offsets (``numbered``), and pivoted back by the key. No task sees all values of a
    column. A null value has no percentile.
    """
    rows = cut(rows)
    each = rows.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.col(v).cast("double") for v in values]))).alias("_f", "_v"))
    each = each.where("_v is not null")
    ranks = numbered(each.select("_f", "_v").distinct(), ["_f", "_v"], "_at")
    spans = ranks.groupBy("_f").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    share = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col("_at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    found = ranks.join(F.broadcast(spans), "_f").select("_f", "_v", share.alias("_p"))  # a row for each column
    wide = each.join(found, ["_f", "_v"]).groupBy(key).agg(*[F.max(F.when(F.col("_f") == v, F.col("_p"))).alias(f"{v}_pct") for v in values])
    return rows.join(wide, key, "left")


def feature_pass(papers: DataFrame, edges: DataFrame, anchors: DataFrame, policy: Policy, as_of: int) -> DataFrame:
    """Percentile features of every paper of the session (``papers``), its score and the map of its terms.

    Overlap, co-citation and coupling count over the whole corpus; ``hub`` is the in-degree among the
    session's papers only. A venue counts by its acronym or full name (``filters.core_venue``).
    """
    own, edges = anchors.select("paper_id").distinct(), cut(edges)
    near = graph.incident(edges, own)
    pairs = near.select(F.col("citing_id").alias("a"), F.col("cited_id").alias("p")).unionByName(near.select(F.col("cited_id").alias("a"), F.col("citing_id").alias("p")))
    overlap = pairs.join(own.withColumnRenamed("paper_id", "a"), "a", "left_semi").groupBy(F.col("p").alias("paper_id")).agg(F.countDistinct("a").alias("overlap_raw"))
    raw = (
        papers.join(overlap, "paper_id", "left")
        .join(graph.induced(edges, papers).groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("hub_raw")), "paper_id", "left")
        .join(graph.cocitation(edges, own).withColumnRenamed("cocited", "cocite_raw"), "paper_id", "left")
        .join(graph.coupling(edges, own).withColumnRenamed("coupled", "bibcoup_raw"), "paper_id", "left")
        .na.fill(0, ["overlap_raw", "hub_raw", "cocite_raw", "bibcoup_raw"])
        .withColumn("quality_raw", scores.ranked_rate(F.col("citation_count"), F.col("year"), as_of))
        .withColumn("recency_raw", scores.recency(F.col("year"), as_of, policy.half_life))
    )
    names = ["overlap", "quality", "recency", "hub", "cocite", "bibcoup"]
    made = percentiles(raw, "paper_id", [f"{f}_raw" for f in names])
    for f in names:
        made = made.withColumnRenamed(f"{f}_raw_pct", f)
    made = made.withColumn("venue_hit", filters.core_venue(F.col("venue"), policy).cast("double"))
    score, terms = scores.weighted({**{n: F.col(n) for n in names}, "venue": F.col("venue_hit")}, policy.weights)
    return made.withColumn("score", score).withColumn("breakdown", terms)


#: Fixed value: h-indices from here on say no more.
MOST_H = 60


def author_prior(papers: DataFrame, bylines: DataFrame, authors: DataFrame, young: Column | None = None) -> DataFrame:
    """(paper_id, h_index, known, authors, author_prior): what the authors say of papers that nothing else speaks of yet.

    ``bylines`` (paper_id, author_id, position) are joined with ``authors`` (author_id, name, h_index): the greatest known
    h-index of a paper's authors (null where none is known), how many are known, and the names in the order of the byline.
    ``author_prior`` is the percentile of that h-index (from ``MOST_H`` on all count alike) among the papers that have one; with ``young``, a condition on ``papers``, only
    papers that fulfil it have a prior and count for it. An author with very many papers is joined by ``join_hot``.
    """
    own = cut(bylines.select("paper_id", "author_id", "position").where("author_id is not null"))
    table = authors.groupBy("author_id").agg(F.max("name").alias("name"), F.max("h_index").alias("h_index"))
    met = join_hot(own, table, "author_id", own.count())
    byline = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda a: a["name"])
    found = met.groupBy("paper_id").agg(F.max("h_index").alias("h_index"), F.count("h_index").alias("known"), byline.alias("authors"))
    rows = papers.select("paper_id", (F.lit(True) if young is None else F.coalesce(young, F.lit(False))).alias("_young")).join(found, "paper_id", "left")
    rows = rows.withColumn("_h", F.when(F.col("_young") & F.col("h_index").isNotNull(), F.least("h_index", F.lit(MOST_H))))
    made = percentiles(rows, "paper_id", ["_h"]).withColumnRenamed("_h_pct", "author_prior")
    return made.select("paper_id", "h_index", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "author_prior")


def rescore(nodes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores from stored feature maps; a node without features has none."""
    found = {n: F.try_element_at("features", F.lit(n)) for n in weights}
    score, terms = scores.weighted(found, weights)
    bare = F.col("features").isNull() | (F.size("features") == 0)
    return nodes.withColumn("score", F.when(~bare, score)).withColumn("breakdown", F.when(~bare, terms))


def sweep(nodes: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """(run, …, score) of every node under each weight configuration of ``grid``, from the stored feature maps.

    One pass over the nodes, however many configurations: each row yields all of its scores.
    """
    found = lambda n: F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0))
    total = lambda weights: sum((F.lit(float(w)) * found(n) for n, w in sorted(weights.items())), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(i).alias("run"), total(w).alias("score")) for i, w in enumerate(grid)])
    return nodes.where(F.size("features") > 0).select("*", F.explode(each).alias("_x")).select("*", "_x.run", "_x.score").drop("_x")


def build_pool(edges: DataFrame, papers: DataFrame, frontier: DataFrame, excluded: DataFrame, policy: Policy, as_of: int) -> DataFrame:
    """Neighbours of all frontier papers in one grouping: distinct anchors, direction, intents, influence, age, prescore.

    Hubs are not expanded forward; what is in the graph, removed or not accepted is left out. Edges
    without ``intents`` or ``is_influential`` count as having none.
    """
    if "intents" not in edges.columns:
        edges = edges.withColumn("intents", F.lit(None).cast("array<string>"))
    if "is_influential" not in edges.columns:
        edges = edges.withColumn("is_influential", F.lit(False))
    hubs = papers.where(F.col("citation_count") > policy.forward_expand_max).select("paper_id")
    own = frontier.select("paper_id").distinct()
    back = edges.join(own.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").select(
        F.col("cited_id").alias("paper_id"), F.col("citing_id").alias("anchor"), F.lit("BACKWARD").alias("direction"), "intents", "is_influential"
    )
    fine = own.join(hubs, "paper_id", "left_anti")
    forward = edges.join(fine.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi").select(
        F.col("citing_id").alias("paper_id"), F.col("cited_id").alias("anchor"), F.lit("FORWARD").alias("direction"), "intents", "is_influential"
    )
    gone = excluded.select("paper_id").unionByName(own).distinct()
    pool = (
        back.unionByName(forward)
        .join(gone, "paper_id", "left_anti")
        .groupBy("paper_id")
        .agg(
            F.countDistinct("anchor").alias("anchor_overlap"),
            F.min("direction").alias("direction"),
            F.array_sort(F.collect_set("anchor")).alias("sources"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("intents")))).alias("intents"),
            F.coalesce(F.bool_or("is_influential"), F.lit(False)).alias("is_influential"),
        )
    )
    method = F.array_contains("intents", "methodology")
    return (
        pool.join(papers, "paper_id")
        .withColumn("age_years", F.greatest(scores.age(F.col("year"), as_of), F.lit(0.0)))
        .withColumn("prescore", scores.prescore(F.col("anchor_overlap"), method, F.col("is_influential"), F.col("citation_count"), F.col("age_years"), policy.forward_expand_max))
    )


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a totally ordered listing, with the size of the whole listing as ``total``."""
    rows = cut(rows)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def excluded(nodes: DataFrame, gone: DataFrame, refused: DataFrame, frontier: DataFrame) -> DataFrame:
    """What a pool leaves out: the frontier, papers in the graph, removed ones, those that the filters did not accept."""
    return frontier.select("paper_id").unionByName(nodes.select("paper_id")).unionByName(gone.select("paper_id")).unionByName(refused.select("paper_id")).distinct()


def candidate_order(key: str) -> list[Column]:
    return [F.desc_nulls_last(key), F.asc("paper_id")]


def picks(fit: list[dict], budget: int, policy: Policy) -> list[dict]:
    """The first picks from rows in falling order: recency lane, floors for both directions, then by score."""
    lane = max(1, int(policy.recency_lane * budget))
    picked = [p for p in fit if p["age_years"] < 1.0][:lane]
    seen = {p["paper_id"] for p in picked}
    least = int(policy.direction_floor * (budget - len(picked)))
    for way in ("BACKWARD", "FORWARD"):
        for p in [q for q in fit if q["direction"] == way and q["paper_id"] not in seen][:least]:
            if len(picked) < budget:
                picked.append(p)
                seen.add(p["paper_id"])
    for p in fit:
        if len(picked) >= budget:
            break
        if p["paper_id"] not in seen:
            picked.append(p)
            seen.add(p["paper_id"])
    return picked


class Choice:
    """A session's choice under the source cap: ``kept`` rows, ``dropped`` ones, and how often each source is used.

    Rows are dicts of paper_id, score and sources. ``refill`` may be called with block after block of the pool in falling order.
    """

    def __init__(self, budget: int, policy: Policy, state: str | None = None):
        self.budget, self.cap = budget, max(1, int(policy.source_cap * budget))
        held = json.loads(state) if state else {"kept": [], "dropped": [], "used": [], "taken": []}
        self.kept, self.dropped = held["kept"], held["dropped"]
        self.used, self.taken = Counter(dict(held["used"])), set(held["taken"])

    def _admit(self, p: dict) -> bool:
        if any(self.used[s] >= self.cap for s in p["sources"]):
            return False
        self.used.update(p["sources"])
        return True

    def start(self, picked: list[dict]) -> Choice:
        self.taken = {p["paper_id"] for p in picked}
        for p in self.best(picked):
            (self.kept if self._admit(p) else self.dropped).append(p)
        return self

    @property
    def done(self) -> bool:
        return not self.dropped or len(self.kept) >= self.budget

    def refill(self, rows: list[dict]) -> Choice:
        for p in rows:
            if self.done:
                break
            if p["paper_id"] not in self.taken and self._admit(p):
                self.kept.append(p)
        return self

    def rows(self) -> list[dict]:
        """The chosen rows; places that nothing else fills go back to the rows that were dropped."""
        return self.best(self.kept + self.dropped[: max(0, self.budget - len(self.kept))])

    @staticmethod
    def best(rows: list[dict]) -> list[dict]:
        return sorted(rows, key=lambda p: (-p["score"], p["paper_id"]))

    def state(self) -> str:
        return json.dumps({"kept": self.kept, "dropped": self.dropped, "used": list(self.used.items()), "taken": sorted(self.taken)})


def choose(pool: list[dict], budget: int, policy: Policy) -> list[dict]:
    """Picks of a small pool within a budget: score floor, lanes and floors, then at most a share of the budget from
    one source unless places would stay empty."""
    fit = Choice.best([{**p, "sources": [] if p["sources"] is None else list(p["sources"])} for p in pool if p["score"] >= policy.score_floor])
    if budget <= 0 or not fit:
        return []
    return Choice(budget, policy).start(picks(fit, budget, policy)).refill(fit).rows()


#: Rows of a session that one step of the refill looks at, for each place of the budget.
BLOCK = 64


def allocate(pool: DataFrame, budget: int, policy: Policy) -> DataFrame:
    """``choose`` for each session, (session_id, paper_id, position, score), without bringing a session's pool together.

    The first picks come from the best rows of the session, of its recent papers and of each direction; each of these
    is cut by rank before anything is shuffled. Only sessions whose source cap left places open go on: their rows, numbered
    by sorted parts, are walked through in blocks of ``BLOCK * budget`` in falling order until every place is taken or
    the pool ends, so the choice is exact and a task holds one block and the session's choice.
    """
    made = "session_id long, paper_id long, position int, score double"
    fit = pool.where(F.col("score") >= policy.score_floor).select(F.col("session_id").cast("long").alias("session_id"), F.col("paper_id").cast("long").alias("paper_id"), "score", "age_years", "direction", F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))
    if budget <= 0:
        return fit.select("session_id", "paper_id", F.lit(0).alias("position"), "score").where("false")
    fit = cut(fit)
    order = [F.desc("score"), F.asc("paper_id")]

    def top(rows: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("session_id", *by).orderBy(*order))
        return rows.withColumn("_n", place).where(F.col("_n") <= 2 * budget).drop("_n")

    near = top(fit).unionByName(top(fit.where("age_years < 1.0"))).unionByName(top(fit, "direction")).dropDuplicates(["session_id", "paper_id"])
    state = "session_id long, state binary, done boolean"
    records = lambda pdf: [{"paper_id": int(i), "score": float(s), "sources": [int(x) for x in own]} for i, s, own in zip(pdf["paper_id"], pdf["score"], pdf["sources"], strict=True)]
    told = lambda session, c: pd.DataFrame({"session_id": [int(session)], "state": [c.state().encode()], "done": [c.done]})

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "paper_id"], ascending=[False, True])
        rows = [{**r, "age_years": a, "direction": d} for r, a, d in zip(records(pdf), pdf["age_years"], pdf["direction"], strict=True)]
        chosen = [{k: p[k] for k in ("paper_id", "score", "sources")} for p in picks(rows, budget, policy)]
        return told(pdf["session_id"].iloc[0], Choice(budget, policy).start(chosen))

    def go_on(held: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return pd.DataFrame({"session_id": pd.Series([], dtype="int64"), "state": pd.Series([], dtype="object"), "done": pd.Series([], dtype="bool")})
        rows = records(pdf.sort_values("_at"))
        return told(held["session_id"].iloc[0], Choice(budget, policy, held["state"].iloc[0]).refill(rows))

    def finish(frames):
        for pdf in frames:
            rows = [(s, p["paper_id"], i + 1, p["score"]) for s, x in zip(pdf["session_id"], pdf["state"], strict=True) for i, p in enumerate(Choice(budget, policy, x).rows())]
            yield pd.DataFrame(rows, columns=["session_id", "paper_id", "position", "score"])

    now = cut(near.groupBy("session_id").applyInPandas(begin, state))
    done, pending = now.where("done"), now.where("not done")
    if not pending.isEmpty():
        placed = cut(ranked_within(fit.join(pending.select("session_id"), "session_id", "left_semi").select("session_id", "paper_id", "score", "sources"), "session_id", order, "_at"))
        longest, block = placed.agg(F.max("_at")).first()[0], BLOCK * budget
        for low in range(0, longest, block):
            rows = placed.where(F.col("_at").between(low + 1, low + block))
            moved = cut(pending.groupBy("session_id").cogroup(rows.groupBy("session_id")).applyInPandas(go_on, state))
            done, pending = done.unionByName(moved.where("done")), moved.where("not done")
            if pending.isEmpty():
                break
        done = done.unionByName(pending)
    return done.mapInPandas(finish, made)
