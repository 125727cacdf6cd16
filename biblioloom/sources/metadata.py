"""Metadata sources: JSON lines, harvest XML, API pages, reading lists, the response cache."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioloom.sources.archive import read_archives

PAPER = (
    "paperId string, title string, year int, publicationDate string, venue string, citationCount long, referenceCount long,"
    " externalIds struct<DOI:string,ArXiv:string>, fieldsOfStudy array<string>, publicationTypes array<string>,"
    " authors array<struct<authorId:string,name:string,hIndex:int>>"
)
HARVEST = "id string, categories string, created string, updated string"


def snapshot(lines: DataFrame) -> DataFrame:
    """JSON lines (value) to (arxiv_id, primary_category, categories, updated); bad lines are skipped."""
    good = _parsed(lines).where("_good")
    return good.select("arxiv_id", F.element_at("categories", 1).alias("primary_category"), "categories", "updated")


def _parsed(lines: DataFrame) -> DataFrame:
    """Every line, with ``_good`` where it has an id and a category."""
    row = F.from_json("value", "id string, categories string, update_date string")
    found = lines.select(row.alias("r")).select(F.col("r.id").alias("arxiv_id"), F.split(F.trim("r.categories"), r"\s+").alias("categories"), F.col("r.update_date").alias("updated"))
    good = F.col("arxiv_id").isNotNull() & (F.length(F.trim("arxiv_id")) > 0) & (F.try_element_at("categories", F.lit(1)) != "")
    return found.withColumn("_good", F.coalesce(good, F.lit(False)))


def read_snapshot(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A snapshot file or folder: JSON lines, or zip archives of them; at most ``limit`` lines where it is given.

    Archives are read member by member (``archive``), whatever their size.
    """
    lines = read_archives(spark, path).select("value") if path.endswith(".zip") else spark.read.text(path)
    return snapshot(lines if limit is None else lines.limit(limit))


def watermark(lines: DataFrame) -> DataFrame:
    """One row: lines loaded, lines skipped, the latest update; one pass over the lines."""
    found = _parsed(lines)
    return found.agg(F.count_if("_good").alias("loaded"), F.count_if(~F.col("_good")).alias("skipped"), F.max(F.when(F.col("_good"), F.col("updated"))).alias("watermark"))


def harvest_pages(pages: DataFrame, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Whole answers (page_id, value) to (records, (page_id, token)); names count without their namespaces.

    An empty or missing resumption token is null, which ends a harvest; a page that is no XML has neither. Records have
    the columns ``keep`` of their page beside their own.
    """
    bare = F.regexp_replace(F.regexp_replace("value", r"<(/?)[A-Za-z_][\w.-]*:", "<$1"), r"\s(?:xmlns(?::[\w.-]+)?|[\w.-]+:[\w.-]+)=(\"[^\"]*\"|'[^']*')", "")
    clean = pages.select("page_id", *[c for c in keep if c != "page_id"], bare.alias("value"))
    blocks = clean.select(*keep, F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<record\b.*?</record>"), F.lit(0))).alias("record"))
    inner = blocks.select(*keep, F.regexp_extract("record", r"(?s)<arXiv\b[^>]*>.*?</arXiv>", 0).alias("value")).where("value <> ''")
    token = F.trim(F.regexp_extract("value", r"(?s)<resumptionToken\b[^>]*>([^<]*)</resumptionToken>", 1))
    return harvest(inner, keep), clean.select("page_id", F.when(token != "", token).alias("token"))


def harvest_params(since: str | None = None, kind: str = "cs", token: str | None = None) -> dict[str, str]:
    """The parameters of the next harvest request; a token stands alone."""
    if token:
        return {"verb": "ListRecords", "resumptionToken": token}
    return {"verb": "ListRecords", "metadataPrefix": "arXiv", "set": kind, **({"from": since} if since else {})}


def harvest(records: DataFrame, keep: tuple = ()) -> DataFrame:
    """XML records (value) to the same shape, with the columns ``keep``; ``updated`` else ``created``."""
    r = F.from_xml("value", HARVEST)
    found = records.select(*keep, r.alias("r"))
    return found.where(F.col("r.id").isNotNull() & (F.trim(F.coalesce("r.categories", F.lit(""))) != "")).select(
        F.col("r.id").alias("arxiv_id"),
        F.element_at(F.split(F.trim("r.categories"), r"\s+"), 1).alias("primary_category"),
        F.split(F.trim("r.categories"), r"\s+").alias("categories"),
        F.coalesce("r.updated", "r.created").alias("updated"),
        *keep,
    )


def latest_metadata(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Batched upsert: the last row of each id."""
    from biblioloom.operators.corpus import keep_last

    return keep_last(rows, "arxiv_id", seq)


def papers(pages: DataFrame) -> DataFrame:
    """API papers (JSON in value) to rows; without id or title they are dropped, null counts are 0."""
    return _paper_rows(pages.select(F.from_json("value", PAPER).alias("p")))


def neighbour_papers(pages: DataFrame) -> DataFrame:
    """Neighbour pages (center, direction, value) to the paper at the other end of each edge, as ``papers`` gives it, beside its center and
    direction: what ``ingest`` takes. Papers without id or title and the center itself are dropped."""
    paper = "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", PAPER) + ">"
    each = pages.select("center", "direction", F.explode(F.from_json("value", f"data array<struct<citedPaper:{paper},citingPaper:{paper}>>")["data"]).alias("d"))
    other = each.select("center", "direction", F.when(F.col("direction") == "BACKWARD", F.col("d.citedPaper")).otherwise(F.col("d.citingPaper")).alias("p"))
    return _paper_rows(other.where("p.paperId <> center"), "center", "direction")


def _paper_rows(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.where("p.paperId is not null and p.title is not null").select(
        *keep, F.col("p.paperId").alias("s2_paper_id"), F.col("p.title").alias("title"), F.col("p.year").alias("year"), F.col("p.venue").alias("venue"),
        F.coalesce("p.citationCount", F.lit(0)).alias("citation_count"), F.col("p.externalIds.DOI").alias("doi"), F.col("p.externalIds.ArXiv").alias("arxiv"),
        F.filter("p.authors", lambda a: a["authorId"].isNotNull() & a["name"].isNotNull()).alias("authors"),
    )


def neighbour_edges(pages: DataFrame) -> DataFrame:
    """Neighbour pages (center, direction, value) to edges, citing to cited; self edges are dropped."""
    item = "array<struct<citedPaper:struct<paperId:string>,citingPaper:struct<paperId:string>,isInfluential:boolean,intents:array<string>>>"
    each = pages.select("center", "direction", F.explode(F.from_json("value", f"data {item}")["data"]).alias("d"))
    back = F.col("direction") == "BACKWARD"
    other = F.when(back, F.col("d.citedPaper.paperId")).otherwise(F.col("d.citingPaper.paperId"))
    made = each.select(
        F.when(back, F.col("center")).otherwise(other).alias("citing"), F.when(back, other).otherwise(F.col("center")).alias("cited"),
        "direction", F.col("d.isInfluential").alias("is_influential"), F.col("d.intents").alias("intents"),
    )
    return made.where("citing is not null and cited is not null and citing <> cited")


def cache_key(endpoint, params):
    """SHA-256 of the endpoint, a NUL and the parameters (a map) as JSON in key order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.sha2(F.concat(endpoint, F.lit("\0"), F.to_json(ordered)), 256)


def cache_put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The response cache (endpoint, params_hash, status_code, response, fetched_at) with ``fresh`` answers over old ones."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in cache.columns if c not in ("endpoint", "params_hash")]
    last = both.groupBy("endpoint", "params_hash").agg(F.max_by(F.struct(*rest), F.struct("_new", "fetched_at")).alias("_r"))
    return last.select("endpoint", "params_hash", "_r.*").select(*cache.columns)


def cache_get(cache: DataFrame, asked: DataFrame, offline: bool = False) -> DataFrame:
    """Requests (endpoint, params) with their answers; ``hit`` tells a cached ``null`` from a miss.

    ``offline`` makes a miss an error when the row is read, so nothing ever goes to the network.
    """
    keyed = asked.withColumn("params_hash", cache_key(F.col("endpoint"), F.col("params")))
    held = cache.select("endpoint", "params_hash", "status_code", "response", F.lit(True).alias("_hit"))
    found = keyed.join(held, ["endpoint", "params_hash"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
    if offline:
        miss = F.raise_error(F.concat(F.lit("not in the cache: "), F.col("endpoint"))).cast("boolean")
        found = found.withColumn("hit", F.when(F.col("hit"), True).otherwise(miss))
    return found


def file_cache(texts: DataFrame) -> DataFrame:
    """The older file cache: (key, value) with the name of its file; a value that is no JSON reads as missing."""
    return texts.select("key", F.concat(F.sha2(F.col("key"), 256), F.lit(".json")).alias("file"), F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("value"))


def seed_lines(lines: DataFrame) -> DataFrame:
    """The older seed loader: trimmed lines that are neither blank nor comments, repeats and all."""
    t = F.trim("value")
    return lines.select("pos", t.alias("title")).where((F.col("title") != "") & ~F.col("title").startswith("#"))


WORK = (
    "id string, doi string, title string, display_title string, publication_year int, cited_by_count long,"
    " ids struct<arxiv:string>, authorships array<struct<author:struct<display_name:string>>>,"
    " primary_location struct<source:struct<display_name:string>>,"
    " concepts array<struct<display_name:string,level:int>>, abstract_inverted_index map<string,array<int>>"
)


def works(pages: DataFrame) -> DataFrame:
    """Works of the older source (JSON in value) to paper rows; concepts down to level 1."""
    w = F.from_json("value", WORK)
    doi = F.regexp_replace(F.coalesce("w.doi", F.lit("")), "https?://doi[.]org/", "")
    arxiv = F.col("w.ids.arxiv")
    named = lambda items, get: F.filter(F.transform(F.coalesce(items, F.array()), get), lambda n: n.isNotNull() & (n != ""))
    low = F.filter(F.col("w.concepts"), lambda c: F.coalesce(c["level"], F.lit(99)) <= 1)
    text = F.when(F.size(F.map_keys("w.abstract_inverted_index")) > 0, inverted_abstract(F.col("w.abstract_inverted_index")))
    return pages.select(w.alias("w")).select(
        F.element_at(F.split("w.id", "/"), -1).alias("paper_id"), F.coalesce(F.when(F.col("w.display_title") != "", F.col("w.display_title")), "w.title", F.lit("")).alias("title"),
        text.alias("abstract"), F.col("w.publication_year").alias("year"),
        F.when(F.col("w.primary_location.source.display_name") != "", F.col("w.primary_location.source.display_name")).alias("venue"),
        named(F.col("w.authorships"), lambda a: a["author"]["display_name"]).alias("authors"),
        F.when(arxiv.contains("arxiv"), F.element_at(F.split(arxiv, "arxiv[.]org/abs/"), -1)).alias("arxiv_id"), F.when(doi != "", doi).alias("doi"),
        F.coalesce("w.cited_by_count", F.lit(0)).alias("citation_count"), named(low, lambda c: c["display_name"]).alias("field_of_study"), F.lit("openalex").alias("source_api"),
    )


RECORD = (
    "paperId string, title string, abstract string, year int, venue string, citationCount long, externalIds struct<DOI:string,ArXiv:string>,"
    " authors array<struct<name:string>>, tldr struct<text:string>, embedding struct<vector:array<float>>, fieldsOfStudy array<string>"
)


def records(pages: DataFrame) -> DataFrame:
    """Records of the older client (JSON in value) to the same paper rows."""
    names = F.filter(F.transform(F.coalesce("r.authors", F.array()), lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    return pages.select(F.from_json("value", RECORD).alias("r")).where("r.paperId is not null").select(
        F.col("r.paperId").alias("paper_id"), F.coalesce("r.title", F.lit("")).alias("title"), "r.abstract", "r.year", "r.venue", names.alias("authors"),
        F.col("r.externalIds.ArXiv").alias("arxiv_id"), F.col("r.externalIds.DOI").alias("doi"), F.coalesce("r.citationCount", F.lit(0)).alias("citation_count"),
        F.col("r.tldr.text").alias("tldr"), F.col("r.embedding.vector").alias("embedding"), F.coalesce("r.fieldsOfStudy", F.array()).alias("field_of_study"),
        F.lit("semantic_scholar").alias("source_api"),
    )


def reading_list(lines: DataFrame) -> DataFrame:
    """(pos, value) lines to titles: no BOM, blanks or ``#`` comments; case-insensitive repeats keep the first."""
    t = F.trim(F.regexp_replace("value", "^﻿", ""))
    kept = lines.select("pos", t.alias("title")).where((F.col("title") != "") & ~F.col("title").startswith("#"))
    w = Window.partitionBy(F.lower("title")).orderBy("pos")
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pos", "title")


def inverted_abstract(index):
    """The text that a map of word to positions stands for."""
    each = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["w"]), " ")


def export(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)
