"""The filter cascade: ordered verdicts (outcome, stage, reason), and the store of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from biblioloom.config import ALLOWED_FIELDS, EXCLUDED_FIELDS, TOPIC_GROUPS, GateTerms, Policy
from biblioloom.functions.scores import survey_rate
from biblioloom.operators.lineage import counted

# Title patterns of the type stage.
SURVEY = r"(?i)^(?:(?:a|an|the)\s+)?(?:\w+\s+){0,2}(survey|review|overview)\b(?=\s+(?:of|on|in|for)\b|\s*[:\-]|$)"
BENCHMARK = r"(?i)\b(benchmark|benchmarks|dataset|datasets|test ?suite)\b"
# Full names of the core venues, and fields that are not about computer science.
VENUE_NAMES = {
    "NeurIPS": ("neural information processing systems",),
    "ICML": ("international conference on machine learning",),
    "ICLR": ("international conference on learning representations",),
    "ACL": ("annual meeting of the association for computational linguistics",),
    "EMNLP": ("empirical methods in natural language processing",),
    "NAACL": ("north american chapter of the association for computational linguistics",),
    "AAAI": ("aaai conference on artificial intelligence",),
    "IJCAI": ("international joint conference on artificial intelligence",),
    "COLT": ("conference on learning theory",),
    "AISTATS": ("international conference on artificial intelligence and statistics",),
    "TMLR": ("transactions on machine learning research",),
    "JMLR": ("journal of machine learning research",),
    "COLM": ("conference on language modeling",),
    "EACL": ("european chapter of the association for computational linguistics",),
    "CoNLL": ("conference on computational natural language learning",),
}
NON_CS_FIELDS = (
    "medicine", "biology", "chemistry", "physics", "economics", "business", "geology",
    "materials science", "environmental science", "agricultural and food sciences",
)
VERDICT = "struct<outcome:string,stage:string,reason:string>"


def verdict(outcome: str, stage: str, reason: str) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))


def era(year: Column, policy: Policy) -> Column:
    return (
        F.when(year.isNull(), verdict("QUARANTINE", "ERA", "YEAR_UNKNOWN"))
        .when(year < policy.year_floor, verdict("REJECT", "ERA", "PRE_ERA"))
        .otherwise(verdict("ACCEPT", "ERA", "OK"))
    )


def paper_kind(title: Column, types: Column, citations: Column, year: Column, policy: Policy, as_of: int) -> Column:
    kinds = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    title = F.coalesce(title, F.lit(""))
    good = (citations >= policy.survey_min_citations) | (survey_rate(citations, year, as_of) >= policy.survey_min_rate)
    return (
        F.when(F.array_contains(kinds, "dataset"), verdict("REJECT", "TYPE", "IS_DATASET"))
        .when(
            title.rlike(SURVEY) | F.array_contains(kinds, "review"),
            F.when(F.coalesce(good, F.lit(False)), verdict("ACCEPT", "TYPE", "SURVEY_WELL_CITED")).otherwise(verdict("REJECT", "TYPE", "LOW_CITE_SURVEY")),
        )
        .when(title.rlike(BENCHMARK), verdict("QUARANTINE", "TYPE", "MAYBE_BENCHMARK"))
        .otherwise(verdict("ACCEPT", "TYPE", "OK"))
    )


def in_categories(category: Column, names: tuple) -> Column:
    """Equal to one of the names, or below a family ``fam.*`` (its dot included)."""
    exact = [n for n in names if not n.endswith(".*")]
    found = category.isin(exact) if exact else F.lit(False)
    for n in names:
        if n.endswith(".*"):
            found = found | category.startswith(n[:-1])
    return F.coalesce(found, F.lit(False))


def any_term(text: Column, terms: tuple) -> Column:
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for t in terms:
        found = found | low.contains(t)
    return found


def core_venue(venue: Column, policy: Policy) -> Column:
    """A core venue by its acronym as a whole word, or by its full name anywhere."""
    low, found = F.lower(F.trim(venue)), F.lit(False)
    for v in policy.core_venues:
        found = found | low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){v.lower().replace('#', '[#]')}(?![\p{{L}}\p{{N}}_])")
        for name in VENUE_NAMES.get(v, ()):
            found = found | low.contains(name)
    return F.coalesce(found, F.lit(False))


def topic(title: Column, primary: Column, crossed: Column, venue: Column, fields: Column, policy: Policy) -> Column:
    """The topic rungs in order: rescue terms, the primary category (it decides whatever the others say),
    and only without one a core cross-listing, the venue, the fields."""
    primary = F.when(primary != "", primary)
    core = in_categories(primary, policy.core_allow)
    fields = F.array_distinct(F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.trim(F.lower(f))))
    crossed = F.coalesce(crossed, F.array().cast("array<string>"))
    cs = F.array_contains(fields, "computer science")
    return (
        F.when(~core & any_term(title, policy.biochem_terms), verdict("ACCEPT", "TOPIC", "BIOCHEM_ML"))
        .when(~core & any_term(title, policy.reaction_terms), verdict("ACCEPT", "TOPIC", "REACTION_ML"))
        .when(core, verdict("ACCEPT", "TOPIC", "CAT_PRIMARY_CORE"))
        .when(in_categories(primary, policy.applied_deny), verdict("REJECT", "TOPIC", "CAT_PRIMARY_APPLIED"))
        .when(in_categories(primary, policy.borderline), verdict("QUARANTINE", "TOPIC", "CAT_PRIMARY_BORDERLINE"))
        .when(primary.isNotNull(), verdict("QUARANTINE", "TOPIC", "CAT_NOT_ALLOWED"))
        .when(F.exists(crossed, lambda c: in_categories(c, policy.core_allow)), verdict("ACCEPT", "TOPIC", "CAT_CROSS_CORE"))
        .when(core_venue(venue, policy), verdict("ACCEPT", "TOPIC", "VENUE_CORE"))
        .when(cs & (F.size(fields) == 1), verdict("QUARANTINE", "TOPIC", "FIELD_CS_ONLY"))
        .when(~cs & F.arrays_overlap(fields, F.array(*map(F.lit, NON_CS_FIELDS))), verdict("REJECT", "TOPIC", "FIELD_NON_CS"))
        .otherwise(verdict("QUARANTINE", "TOPIC", "NO_SIGNAL"))
    )


def first_stop(*stages: Column) -> Column:
    """The first verdict that is not ACCEPT, else the last stage's."""
    out = stages[-1]
    for s in reversed(stages[:-1]):
        out = F.when(s["outcome"] != "ACCEPT", s).otherwise(out)
    return out


def cascade(papers: DataFrame, policy: Policy, as_of: int) -> DataFrame:
    """Adds ``verdict``; optional columns (types, crossed, fields) count as empty where missing."""
    col = lambda n, t: F.col(n) if n in papers.columns else F.lit(None).cast(t)
    title, year, citations = F.col("title"), F.col("year"), F.col("citation_count")
    return papers.withColumn(
        "verdict",
        first_stop(
            era(year, policy),
            paper_kind(title, col("types", "array<string>"), citations, year, policy, as_of),
            topic(title, col("category", "string"), col("crossed", "array<string>"), col("venue", "string"), col("fields", "array<string>"), policy),
        ),
    )


def cached_cascade(papers: DataFrame, decisions: DataFrame, policy: Policy, as_of: int) -> DataFrame:
    """Global rejections of the same policy version are reused; adds ``verdict`` and ``hit``."""
    known = (
        decisions.where(F.col("session_id").isNull() & (F.col("outcome") == "REJECT") & (F.col("config_version") == policy.version))
        .select("paper_id", F.struct("outcome", "stage", "reason").alias("known"))
        .dropDuplicates(["paper_id"])
    )
    judged = cascade(papers.join(known, "paper_id", "left"), policy, as_of)
    return judged.withColumn("hit", F.col("known").isNotNull()).withColumn("verdict", F.coalesce("known", "verdict")).drop("known")


def counted_cascade(papers: DataFrame, decisions: DataFrame, policy: Policy, as_of: int) -> tuple[DataFrame, Observation]:
    """``cached_cascade`` and what it met (papers, hits, accepted, quarantined, rejected), counted in the pass that uses it."""
    outcome = lambda o: F.count_if(F.col("verdict.outcome") == o)
    return counted(
        cached_cascade(papers, decisions, policy, as_of), papers=F.count("*"), hits=F.count_if("hit"),
        accepted=outcome("ACCEPT"), quarantined=outcome("QUARANTINE"), rejected=outcome("REJECT"),
    )


def record(decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Decisions after ``fresh`` ones replaced those of the same paper, scope and version."""
    same = (
        (decisions["paper_id"] == fresh["paper_id"])
        & decisions["session_id"].eqNullSafe(fresh["session_id"])
        & (decisions["config_version"] == fresh["config_version"])
    )
    return decisions.join(fresh, same, "left_anti").unionByName(fresh)


def non_accepted(decisions: DataFrame, session_id: int, version: str) -> DataFrame:
    scope = F.col("session_id").isNull() | (F.col("session_id") == session_id)
    return decisions.where(scope & (F.col("config_version") == version) & (F.col("outcome") != "ACCEPT")).select("paper_id").distinct()


def report(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.col("verdict.outcome").alias("outcome"), F.col("verdict.reason").alias("reason")).agg(F.count("*").alias("n"))


def review(decisions: DataFrame, papers: DataFrame, session_id: int, outcome: str, limit: int) -> DataFrame:
    """The newest ``limit`` decisions of an outcome with their papers, how many there are in all, and whether
    the listing is cut. ``decisions`` has an id that grows with time."""
    own = decisions.where((F.col("outcome") == outcome) & (F.col("session_id").isNull() | (F.col("session_id") == session_id)))
    total = own.agg(F.count("*").alias("total"))
    rows = own.join(papers.select("paper_id", "title", "year"), "paper_id").orderBy(F.desc("id")).limit(limit)
    return rows.join(F.broadcast(total)).select("id", "paper_id", "title", "stage", "reason", "year", "total", (F.col("total") > limit).alias("truncated"))  # one row


def count_by_reason(decisions: DataFrame, session_id: int | None = None) -> DataFrame:
    """Decisions by outcome and reason: all of them, or those that hold in a session (its own and the global ones)."""
    own = decisions if session_id is None else decisions.where(F.col("session_id").isNull() | (F.col("session_id") == session_id))
    return own.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def review_counts(decisions: DataFrame, session_id: int, outcome: str) -> DataFrame:
    own = decisions.where((F.col("outcome") == outcome) & (F.col("session_id").isNull() | (F.col("session_id") == session_id)))
    return own.groupBy("reason").agg(F.count("*").alias("n"))


def sanity(title: Column, year: Column, retracted: Column) -> Column:
    """Planned last stage: no title, no date, or retracted."""
    return (
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", verdict("REJECT", "SANITY", "EMPTY_TITLE"))
        .when(F.coalesce(retracted, F.lit(False)), verdict("REJECT", "SANITY", "RETRACTED"))
        .when(year.isNull(), verdict("QUARANTINE", "SANITY", "NO_DATE"))
        .otherwise(verdict("ACCEPT", "SANITY", "OK"))
    )


def applied(title: Column, policy: Policy) -> Column:
    """Planned stage: a term of an applied domain puts a paper into quarantine, never out."""
    return F.when(any_term(title, policy.applied_terms), verdict("QUARANTINE", "APPLIED", "APPLIED_TERM")).otherwise(verdict("ACCEPT", "APPLIED", "OK"))


def broad_gate(fields: Column, allowed: tuple = ALLOWED_FIELDS, excluded: tuple = EXCLUDED_FIELDS) -> Column:
    """The older broad gate: papers without fields pass, and those with an allowed field; else a single excluded field drops a paper.

    Fields that are in neither list say nothing.
    """
    fields = F.coalesce(fields, F.array().cast("array<string>"))
    any_of = lambda names: F.exists(fields, lambda f: f.isin(*names))
    return F.coalesce(any_of(allowed), F.lit(False)) | ~F.coalesce(any_of(excluded), F.lit(False))


def strict_gate(title: Column, venue: Column, abstract: Column, fields: Column, terms: GateTerms | None = None) -> tuple[Column, Column, Column]:
    """The older strict gate by plain substrings: (passes, core terms found, applied terms found).

    Behind the broad gate, terms are looked for in title, venue and abstract together; a core venue stands in
    for a core term, and one applied term anywhere rejects.
    """
    terms = terms or GateTerms()
    text = F.lower(F.concat_ws(" ", *[F.when(c != "", c) for c in (title, venue, abstract)]))
    found = lambda names: F.filter(F.array(*map(F.lit, names)), lambda t: F.contains(text, t))
    core, applied = found(terms.core), found(terms.applied)
    passes = broad_gate(fields, terms.allowed, terms.excluded) & (text != "") & ((F.size(core) > 0) | any_term(venue, terms.venues)) & (F.size(applied) == 0)
    return passes, core, applied


def topic_group(title: Column, category: Column, groups: dict = TOPIC_GROUPS) -> Column:
    """The view's group of a paper: the first of ``groups`` whose category prefixes or title terms fit, else ``other``."""
    low, made = F.lower(F.coalesce(title, F.lit(""))), None
    for name, (prefixes, terms) in groups.items():
        fits = F.lit(False)
        for p in prefixes:
            fits = fits | F.coalesce(category.startswith(p), F.lit(False))
        for t in terms:
            fits = fits | low.contains(t)
        made = F.when(fits, name) if made is None else made.when(fits, name)
    return made.otherwise("other")
