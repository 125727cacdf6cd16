"""Dates that may be a year, a year and month, or a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTIAL = r"^[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?$"


def _whole(text: Column, tail: str) -> Column:
    size = F.length(text)
    full = F.when(size == 4, F.concat(text, F.lit("-" + tail))).when(size == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    return F.when(text.rlike(PARTIAL), F.try_to_date(full, "yyyy-MM-dd"))


def earliest(text: Column) -> Column:
    """The first day that a partial date may mean; null if it is none."""
    return _whole(text, "01-01")


def latest(text: Column) -> Column:
    """The last day that a partial date may mean; null if it is none."""
    day = _whole(text, "12-31")
    return F.when(F.length(text) == 7, F.last_day(day)).otherwise(day)


def visible(text: Column, cutoff: Column) -> Column:
    """Whether a paper is surely out by the cutoff; an unknown date is not."""
    return F.coalesce(latest(text) <= cutoff, F.lit(False))
