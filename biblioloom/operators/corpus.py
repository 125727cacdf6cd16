"""Order-safe merges of papers, edges and nodes as grouped folds, and duplicate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.functions.text import normalize_title, surname_of

# How far a paper has been read.
RANKS = {"STUB": 0, "METADATA": 1, "REFS_DONE": 2, "CITES_DONE": 2, "EXPANDED": 3}


def rank_of(state):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p]), state), F.lit(0))


def merge_edges(sightings: DataFrame) -> DataFrame:
    """One row for each edge of its sightings (…, discovered_via, is_influential, intents, seq).

    Two directions become BOTH, influence is a null-safe OR, intents a sorted union; the first
    sighting's time stays. Self edges are dropped.
    """
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("intents"))))
    return sightings.where("citing_id <> cited_id").groupBy("citing_id", "cited_id").agg(
        F.when(F.countDistinct("discovered_via") > 1, "BOTH").otherwise(F.max("discovered_via")).alias("discovered_via"),
        F.bool_or("is_influential").alias("is_influential"),
        F.when(F.count("intents") > 0, union).alias("intents"),
        F.min_by("first_seen_at", "seq").alias("first_seen_at"),
    )


def merge_papers(sightings: DataFrame, guarded: tuple = ("citation_count",), optional: tuple = ("venue", "year")) -> DataFrame:
    """One row for each paper: the furthest state stays, guarded columns follow the highest rank (the
    latest of equals), optional ones the latest value that is known."""
    order = F.struct(rank_of(F.col("crawl_state")), F.col("seq"))
    return sightings.groupBy("paper_id").agg(
        F.max_by("crawl_state", order).alias("crawl_state"),
        *[F.max_by(c, order).alias(c) for c in guarded],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in optional],
        F.min_by("first_seen_at", "seq").alias("first_seen_at"),
    )


def merge_nodes(writes: DataFrame) -> DataFrame:
    """State and depth of the latest write; score, added_by and, where the writes have them, features, breakdown and the position
    (x, y, together) of the latest that names them."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return writes.groupBy("session_id", "paper_id").agg(
        F.max_by("state", "seq").alias("state"), F.max_by("depth", "seq").alias("depth"), known("score"), known("added_by"),
        *[known(c) for c in ("features", "breakdown") if c in writes.columns],
        *([F.max_by(c, F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("seq"))).alias(c) for c in ("x", "y")] if {"x", "y"} <= set(writes.columns) else []),
    )


def keep_last(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def duplicate_groups(keyed: DataFrame) -> DataFrame:
    """(paper_id, canonical_paper_id) by equal canonical keys (column key); the least id stands for all.

    A paper without a key stands for itself.
    """
    least = keyed.where("key is not null").groupBy("key").agg(F.min("paper_id").alias("canonical_paper_id"))
    return keyed.join(least, "key", "left").select("paper_id", F.coalesce("canonical_paper_id", "paper_id").alias("canonical_paper_id"))


def title_matches(probes: DataFrame, papers: DataFrame) -> DataFrame:
    """Least paper with an equal title whose year and first author's surname do not contradict.

    A title without letters or digits is no key and matches nothing. Papers are folded to their least id for each title,
    year and surname, each of which is known, unknown or (for probes that do not know it) any; probes look up at most four
    of these keys, so rows of a very frequent title never meet each other.
    """
    raw = ["title", "year", "author"]
    keyed = lambda rows: rows.withColumns({"t": normalize_title(F.col("title")), "s": surname_of(F.col("author"))}).where("t <> ''")
    key = lambda kind, v, none: F.struct(F.lit(kind).alias("kind"), F.coalesce(v, F.lit(none)).alias("v"))
    held = lambda v, none: F.array(F.when(v.isNull(), key("unknown", v, none)).otherwise(key("is", v, none)), key("any", F.lit(None), none))
    asked = lambda v, none: F.when(v.isNull(), F.array(key("any", v, none))).otherwise(F.array(key("is", v, none), key("unknown", F.lit(None), none)))
    at = lambda rows, side: rows.withColumn("_y", F.explode(side(F.col("year").cast("long"), 0))).withColumn("_s", F.explode(side(F.col("s"), "")))
    p = at(keyed(papers.groupBy(*raw).agg(F.min("paper_id").alias("paper_id"))), held).groupBy("t", "_y", "_s").agg(F.min("paper_id").alias("paper_id"))
    q = at(keyed(probes.select(*raw).distinct()), asked)
    found = q.join(p, ["t", "_y", "_s"]).groupBy(*raw).agg(F.min("paper_id").alias("paper_id"))
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"f.{c}")) for c in raw]
    return probes.alias("q").join(found.alias("f"), same).groupBy("probe_id").agg(F.min("f.paper_id").alias("paper_id"))


def shorter_distance(writes: DataFrame) -> DataFrame:
    """The least distance from a seed, and the union of connections that have it."""
    least = writes.groupBy("paper_id").agg(F.min("distance").alias("distance"))
    at = writes.join(least, ["paper_id", "distance"])
    return at.groupBy("paper_id", "distance").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("connections")))).alias("connections"))


def stub(ids: DataFrame) -> DataFrame:
    """Sightings of papers of which only the id is known (paper_id, seq, first_seen_at), for ``merge_papers``:
    the lowest state, so they never take anything from a paper that is known."""
    return ids.select("paper_id", F.lit("STUB").alias("crawl_state"), F.lit(0).cast("long").alias("citation_count"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("int").alias("year"), "seq", "first_seen_at")


def reuse_by_doi(papers: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes under the id of the paper that has their DOI already, else under their own."""
    held = papers.where("doi is not null").groupBy(F.lower(F.trim("doi")).alias("_doi")).agg(F.min("paper_id").alias("_held"))
    keyed = writes.withColumn("_doi", F.lower(F.trim("doi"))).join(held, "_doi", "left")
    return keyed.withColumn("paper_id", F.coalesce("_held", "paper_id")).drop("_doi", "_held")
