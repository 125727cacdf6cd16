"""String functions: titles, names, identifiers, keys, redaction."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _normal(title: str | None) -> str:
    folded = "".join(c for c in unicodedata.normalize("NFKD", title or "") if not unicodedata.combining(c)).lower()
    words = re.sub(r"[^\w\s]", "", folded).split()
    return " ".join(words[1:] if len(words) > 1 and words[0] in ("a", "an", "the") else words)


@F.pandas_udf(StringType())
def _folded(titles: pd.Series) -> pd.Series:
    return titles.map(_normal, na_action="ignore")


def normalize_title(title: Column) -> Column:
    """NFKD, lower case, no punctuation, single spaces, one leading article dropped; null gives an empty string.

    Plain ASCII stays inside the JVM; only other titles go through Python, in Arrow batches.
    """
    plain = title.rlike(r"^[\x20-\x7E\t\n\r]*$")
    return F.coalesce(ascii_title(F.when(plain, title)), _folded(F.when(~plain, title)), F.lit(""))


def ascii_title(title: Column) -> Column:
    """The same for ASCII titles, inside the JVM."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9_\s]", ""), r"\s+", " "))
    return F.regexp_replace(words, "^(?:a|an|the) (.+)$", "$1")


def surname_of(name: Column) -> Column:
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    return F.regexp_replace(F.lower(last), r"[^\p{L}\p{N}_]", "")


def strip_arxiv_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"v[0-9]+$", "")


def arxiv_id_of(explicit: Column, doi: Column) -> Column:
    """The explicit id, else the one that the DOI holds, without version."""
    found = F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1)
    return F.coalesce(explicit, F.when(found != "", strip_arxiv_version(found)))


def canonical_key(doi: Column, arxiv_id: Column, title: Column, author: Column, year: Column) -> Column:
    """DOI, else arXiv id, else title, surname and year; blank counts as missing, and without any there is no key."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    none = F.lit(None).cast("string")
    key = lambda kind, v, s=none, y=F.lit(None).cast("int"): F.struct(
        F.lit(kind).alias("kind"), v.alias("v"), s.alias("surname"), y.alias("year")
    )
    return (
        F.when(has(doi), key("doi", F.lower(F.trim(doi))))
        .when(has(arxiv_id), key("arxiv", strip_arxiv_version(F.lower(F.trim(arxiv_id)))))
        .when(normalize_title(title) != "", key("title", normalize_title(title), surname_of(author), year))
    )


def identifier_kind(text: Column) -> Column:
    """What a seed line is: doi, arxiv, s2url, openalex, s2id or title, tried in this order."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"(?i)(?:^|doi\.org/|doi:)10\.[0-9]{4,9}/\S+"), "doi")
        .when(t.rlike(r"(?i)^(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)?[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?(?:\.pdf)?$"), "arxiv")
        .when(t.rlike(r"(?i)semanticscholar\.org/"), "s2url")
        .when(t.rlike(r"(?i)^(?:https?://openalex\.org/)?w[0-9]+$"), "openalex")
        .when(t.rlike(r"(?i)^[0-9a-f]{40}$"), "s2id")
        .otherwise("title")
    )


def redact_secrets(line: Column) -> Column:
    """Values after key-like names replaced by asterisks."""
    return F.regexp_replace(line, r"(?i)((?:api[_-]?key|token|authorization|secret)\"?\s*[:=]\s*\"?)[^\s\"&,]+", "$1***")


def cell(value: Column, width: int) -> Column:
    """A table cell: null as a dash, cut with an ellipsis, padded."""
    v = F.coalesce(value.cast("string"), F.lit("-"))
    return F.rpad(F.when(F.length(v) > width, F.concat(F.substring(v, 1, width - 1), F.lit("…"))).otherwise(v), width, " ")


def shorten(title: Column, width: int = 40) -> Column:
    """Cut at a word boundary, with an ellipsis."""
    head = F.substring(title, 1, width - 1)
    return F.when(F.length(title) <= width, title).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r"\s+\S*$", "")), F.lit("…")))
