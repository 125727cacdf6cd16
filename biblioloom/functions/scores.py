"""Scoring expressions; the three ways to count citations per year keep their own names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranked_rate(citations: Column, year: Column, as_of: int) -> Column:
    """Citations per year for ranking: an unknown year gives the raw count."""
    return F.when(year.isNull(), citations.cast("double")).otherwise(citations / F.greatest(F.lit(1), F.lit(as_of) - year + 1))


def survey_rate(citations: Column, year: Column, as_of: int) -> Column:
    """Citations per year for the type filter: an unknown year gives 0."""
    return F.when(year.isNull(), F.lit(0.0)).otherwise(citations / F.greatest(F.lit(1), F.lit(as_of) - year + 1))


def age(year: Column, as_of: int) -> Column:
    return F.coalesce((F.lit(as_of) - year).cast("double"), F.lit(99.0))


def pool_rate(citations: Column, years: Column) -> Column:
    """Citations per year for pooling: ages below half a year count as half a year."""
    return citations / F.greatest(F.lit(0.5), years)


def recency(year: Column, as_of: int, half_life: float = 4.0) -> Column:
    old = F.greatest(F.lit(0), F.lit(as_of) - year)
    return F.when(year.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -old / F.lit(half_life)))


def prescore(overlap: Column, methodology: Column, influential: Column, citations: Column, years: Column, hub: int) -> Column:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return (
        2.0 * overlap
        + 0.8 * flag(methodology)
        + 0.5 * flag(influential)
        + 0.4 * F.log1p(pool_rate(citations, years)) / 5
        + 0.3 * (years < 1.5).cast("int")
        - 0.6 * F.log1p(F.greatest(F.lit(0), citations - hub)) / 10
    )


def weighted(features: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """Sum of weight times feature in name order, and the map of its terms; absent features give no term."""
    terms = {n: F.lit(float(weights[n])) * features[n] for n in sorted(weights) if weights[n] and n in features}
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms.values()), F.lit(0.0))
    return total, F.map_filter(F.create_map(*[x for n, t in terms.items() for x in (F.lit(n), t)]), lambda k, v: v.isNotNull())


def mean_hybrid(similarity: Column, citations: Column, overlap: Column, recent: Column) -> Column:
    """The older four-part score: 0.4, 0.3, 0.2 and 0.1."""
    return 0.4 * similarity + 0.3 * citations + 0.2 * overlap + 0.1 * recent


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def legacy_score(cocited: Column, shared: Column, similarity: Column, citations: Column) -> Column:
    import math

    return (
        0.50 * (1 - F.exp(-(2 * cocited + shared) / 4.0))
        + 0.35 * F.greatest(F.lit(0.0), similarity)
        + 0.15 * F.least(F.lit(1.0), F.log1p(citations) / F.lit(math.log1p(1e4)))
    )


def venue_score(venue: Column, tiers: dict[float, tuple]) -> Column:
    """The tier of the first name that the venue contains, 0.3 for a known other venue, 0 for none."""
    v, out = F.lower(venue), F.when(venue.isNull() | (F.trim(venue) == ""), F.lit(0.0))
    for score in sorted(tiers, reverse=True):
        for name in tiers[score]:
            out = out.when(v.contains(name.lower()), F.lit(score))
    return out.otherwise(F.lit(0.3))


def radius(citations: Column) -> Column:
    return 2 * F.greatest(F.lit(5.0), F.least(F.lit(28.0), 4 + 0.35 * F.sqrt(F.coalesce(citations, F.lit(0)).cast("double"))))
