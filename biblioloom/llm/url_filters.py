"""Operator 1, URL filters: list rules, then association rules mined from labelled URLs.

List rules name a host and a path start; a rule fits its host and all subdomains, and the longest
fitting rule decides. All other URLs get the verdict of mined rules: FP-growth over the token sets
of labelled URLs (with an item for a bad label) yields combinations of tokens. Support and confidence
prune them against the share of bad URLs at large: a combination stays if it holds in ``MIN_COUNT`` (or
``MIN_SUPPORT``) bad URLs, is bad ``MIN_LIFT`` times as often as URLs are, and the lower end of its
confidence interval (``Z`` deviations, for many combinations are tried) lies above that share, so that few
URLs that agree by chance make no rule.
The rules are matched through an inverted index that holds each rule under its rarest token, so
that very common tokens are seldom looked up. A matched URL carries its surest rule.

Before mining, tokens that are too rare in bad URLs for any rule, or that every URL has, are dropped; no rule loses by
that. Tokens that the same labelled URLs hold (told by 128 bits of hashes) are mined as one, as each may stand for the others:
FP-growth lists every frequent combination, which would be 2 to the number of tokens that URLs share. A URL
matches if it holds one token at least of each such class, and names the first rule in the alphabet that these tokens
make. All other combinations are listed, so URLs of many tokens that overlap in part are costly. The SQL keeps the
``ITEMS`` tokens of a URL with the greatest share of bad URLs; where a URL has more, this finds more rules.

Labels belong to numbered documents; a URL is labelled by the last number in its path. A URL is
bad if its document is of quality 0 or toxic. ``judge`` takes other labels as ``baskets``.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the
method's verdict ``allow``; repeated rows are judged each; no labels, no mined rules; of rules with equal
confidence the one with more URLs, then the first in the alphabet, is named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import cut

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_COUNT, MIN_LIFT, Z, ITEMS = 0.002, 5, 1.5, 3.0, 8
BAD = "label:bad"
MINED = "antecedent array<string>, confidence double, lift double, urls long, alike array<array<string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest from ``?`` or ``#`` on; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, F.regexp_extract(rest, r"^[^?#]*([\s\S]*)$", 1)


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting list rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the last one that fits stands
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column, tail: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (digits as 0), query keys, fragment."""
    some = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.split(F.regexp_extract(tail, r"^\?([^#]*)", 1), "&")
    parts = [
        some(F.array(F.substring_index(url, "://", 1)), "s:"),
        some(F.split(host, r"\."), "h:"),
        some(F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0")), "p:"),
        some(F.transform(query, lambda x: F.substring_index(x, "=", 1)), "q:"),
        some(F.array(F.regexp_extract(tail, r"#([\s\S]*)$", 1)), "f:"),
    ]
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def with_parts(pages: DataFrame) -> DataFrame:
    host, path, tail = split_url(F.col("url"))
    found = pages.select("page_id", "url", host.alias("host"), path.alias("path"), tail.alias("_tail"))
    return found.withColumn("tokens", F.coalesce(tokens(F.col("url"), F.col("host"), F.col("path"), F.col("_tail")), F.array().cast("array<string>")))


def baskets_of(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the URLs whose document is labelled."""
    bad = labels.groupBy("doc_id").agg(F.coalesce(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")), F.lit(0)).alias("bad"))
    own = parts.where(F.size("tokens") > 0).select("tokens", F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("doc_id"))
    return own.join(bad, "doc_id").select("tokens", "bad")


def mine(baskets: DataFrame) -> DataFrame:
    """The rules for bad URLs from (tokens, bad): antecedent (sorted), confidence, lift, labelled URLs that hold it.

    ``alike`` has for each token of the antecedent those that the same labelled URLs hold, itself included.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = baskets.sparkSession
    baskets = cut(baskets.select("tokens", F.col("bad").cast("int").alias("bad"), F.monotonically_increasing_id().alias("id")))
    n, n_bad = baskets.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(MIN_COUNT, math.ceil(MIN_SUPPORT * n))
    if n_bad < least:
        return spark.createDataFrame([], MINED)
    held_by = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    seen = baskets.select(F.explode(F.array_distinct("tokens")).alias("token"), "bad", "id").groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), *held_by)
    # at most (tokens of a URL / MIN_SUPPORT) tokens are that frequent, whatever the input
    classes = seen.where((F.col("b") >= least) & (F.col("n") < n)).groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    named = F.map_from_entries(F.collect_list(F.struct(F.element_at("members", 1).alias("t"), F.col("members"))))
    useful = cut(classes.agg(named.alias("_useful")))
    kept = F.filter(F.array_distinct("tokens"), lambda t: F.try_element_at("_useful", t).isNotNull())
    rows = baskets.join(F.broadcast(useful)).select(kept.alias("items"), "bad").where(F.size("items") > 0)  # one row
    rows = rows.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    sets = cut(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=1.0).fit(_padded(rows, n)).freqItemsets)
    held = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n"))
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1))
    bad = bad.select(F.array_sort(F.array_remove("items", BAD)).alias("antecedent"), F.col("freq").alias("b"))
    p, base = F.col("b") / F.col("n"), n_bad / n
    low = (p + Z * Z / (2 * F.col("n")) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * F.col("n"))) / F.col("n"))) / (1 + Z * Z / F.col("n"))
    fit = (p >= min(MIN_LIFT * base, (1 + base) / 2)) & (low > base)
    rules = held.join(bad, "antecedent").where(fit).select("antecedent", p.alias("confidence"), (p / base).alias("lift"), F.col("n").alias("urls"))
    return rules.join(F.broadcast(useful)).select("*", F.transform("antecedent", lambda t: F.try_element_at("_useful", t)).alias("alike")).drop("_useful")


def _padded(rows: DataFrame, n: int) -> DataFrame:
    """FP-growth takes its support as a share of its rows; those without useful tokens were dropped, so empty ones stand in."""
    missing = n - rows.count()
    return rows.unionByName(rows.sparkSession.range(missing).select(F.array().cast("array<string>").alias("items"))) if missing else rows


def matched(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct URLs that hold all tokens of some rule, by the inverted index, with the surest of them."""
    urls = parts.select("url", "tokens").where(F.size("tokens") > 0).dropDuplicates(["url"])
    posted = rules.select("*", F.posexplode("alike").alias("k", "members")).select("*", F.explode("members").alias("token"))
    common = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    own = ["antecedent", "confidence", "lift", "urls", "alike"]
    rated = posted.join(common, "token").groupBy(*own, "k", "members").agg(F.sum("n").alias("n"))
    index = rated.groupBy(*own).agg(F.min_by("members", F.struct("n", "k")).alias("members")).select(*own, F.explode("members").alias("token"))
    fits = F.forall("alike", lambda c: F.arrays_overlap(c, "tokens"))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(fits)
    hits = hits.withColumn("_t", F.array_sort(F.array_intersect("tokens", F.flatten("alike"))))
    last = F.array_max(F.transform("alike", lambda c: F.array_position("_t", F.array_min(F.array_intersect(c, "tokens")))))
    said = F.struct((-F.col("confidence")).alias("c"), (-F.col("urls")).alias("n"), F.array_join(F.slice("_t", F.lit(1), last.cast("int")), " ").alias("mined_rule"), "lift")
    return hits.groupBy("url").agg(F.min(said).alias("_m"))


def judge(pages: DataFrame, labels: DataFrame | None, rules=RULES, baskets=baskets_of) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence, lift) of every row of ``pages``.

    ``baskets`` makes (tokens, bad) of the pages' parts and ``labels``.
    """
    parts = cut(with_parts(pages).drop("_tail"))
    blocked = matched(parts, mine(baskets(parts, labels)))
    return (
        parts.withColumn("_rule", listed(F.col("host"), F.col("path"), rules))
        .join(blocked, "url", "left")
        .select(
            "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", F.when(F.col("_m").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            F.col("_m.mined_rule").alias("mined_rule"), F.round(-F.col("_m.c"), 6).alias("confidence"), F.round("_m.lift", 6).alias("lift"),
        )
    )


def judge_by_language(pages: DataFrame, language: str = "de") -> DataFrame:
    """The same mining on labels that the pages themselves give: which URL tokens tell pages in ``language``?

    ``verdict`` is of the mined rules alone.
    """
    bad = pages.groupBy("url").agg(F.max(F.coalesce(F.lower("html"), F.lit("")).contains(f'lang="{language}"').cast("int")).alias("bad"))
    labelled = lambda parts, _: parts.where(F.size("tokens") > 0).join(bad, "url").select("tokens", "bad")
    return judge(pages, None, (), labelled).drop("rule")


LABELLED = r"""bad AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END), 0) AS bad FROM labels GROUP BY doc_id),
baskets AS (
  SELECT l.row_id, l.tokens, b.bad FROM lists l
  JOIN bad b ON b.doc_id = try_cast(regexp_extract(l.path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) WHERE len(l.tokens) > 0)"""
BY_LANGUAGE = """told AS (SELECT url, max(CASE WHEN contains(lower(coalesce(html, '')), 'lang="de"') THEN 1 ELSE 0 END) AS bad FROM pages GROUP BY url),
baskets AS (SELECT l.row_id, l.tokens, t.bad FROM lists l JOIN told t ON t.url = l.url WHERE len(l.tokens) > 0)"""


def oracle_sql(labelled: str = LABELLED, rules=RULES) -> str:
    """The same in DuckDB SQL: all combinations of the kept tokens of each labelled URL, counted."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    )
    fits = f"CASE {fits} END" if fits else "CAST(NULL AS VARCHAR)"
    rule = "split_part(n.fit, '|', 1) AS rule, " if rules else ""
    return rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id, url,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(rest, ''), '^[^?#]*((?s).*)$', 1) AS tail FROM cut),
lists AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN list_distinct(list_concat(
    ['s:' || x FOR x IN [split_part(url, '://', 1)] IF x <> ''],
    ['h:' || x FOR x IN string_split(host, '.') IF x <> ''],
    ['p:' || regexp_replace(x, '[0-9]+', '0', 'g') FOR x IN string_split(path, '/') IF x <> ''],
    ['q:' || split_part(x, '=', 1) FOR x IN string_split(regexp_extract(tail, '^\?([^#]*)', 1), '&') IF split_part(x, '=', 1) <> ''],
    ['f:' || x FOR x IN [regexp_extract(tail, '#((?s).*)$', 1)] IF x <> ''])) ELSE [] END AS tokens FROM parts),
{labelled},
size AS (SELECT count(*) AS n, sum(bad) AS b, greatest({MIN_COUNT}, ceil({MIN_SUPPORT} * count(*))) AS least FROM baskets),
item AS (SELECT row_id, bad, unnest(tokens) AS t FROM baskets),
useful AS (SELECT t, count(*) AS n, sum(bad) AS b FROM item GROUP BY t HAVING sum(bad) >= (SELECT least FROM size) AND count(*) < (SELECT n FROM size)),
ranked AS (SELECT i.row_id, i.bad, i.t, row_number() OVER (PARTITION BY i.row_id ORDER BY u.b / CAST(u.n AS DOUBLE) DESC, u.n DESC, i.t) AS k FROM item i JOIN useful u ON u.t = i.t),
chosen AS (SELECT row_id, bad, list(t ORDER BY t) AS ts FROM ranked WHERE k <= {ITEMS} GROUP BY row_id, bad),
sets AS (SELECT bad, unnest([[ts[j] FOR j IN range(1, len(ts) + 1) IF (m >> (j - 1)) & 1 = 1] FOR m IN range(1, CAST(1 << len(ts) AS BIGINT))]) AS s FROM chosen),
counted AS (SELECT s, count(*) AS n, sum(bad) AS b, sum(bad) / CAST(count(*) AS DOUBLE) AS p, (SELECT b / CAST(n AS DOUBLE) FROM size) AS base FROM sets GROUP BY s),
rules AS (SELECT s, n, p, p / base AS lift FROM counted WHERE b >= (SELECT least FROM size) AND p >= least({MIN_LIFT} * base, (1 + base) / 2)
  AND (p + {Z * Z} / (2 * n) - {Z} * sqrt((p * (1 - p) + {Z * Z} / (4 * n)) / n)) / (1 + {Z * Z} / n) > base),
hit AS (SELECT row_id, mined_rule, p, lift FROM (SELECT l.row_id, array_to_string(r.s, ' ') AS mined_rule, r.p, r.lift,
  row_number() OVER (PARTITION BY l.row_id ORDER BY r.p DESC, r.n DESC, array_to_string(r.s, ' ')) AS k FROM lists l JOIN rules r ON list_has_all(l.tokens, r.s)) x WHERE k = 1),
named AS (SELECT *, {fits} AS fit FROM lists)
SELECT n.page_id, n.host, n.path, {rule}
  CASE WHEN n.fit IS NOT NULL THEN split_part(n.fit, '|', 2) WHEN h.row_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  h.mined_rule, round(h.p, 6) AS confidence, round(h.lift, 6) AS lift
FROM named n LEFT JOIN hit h ON h.row_id = n.row_id
"""
