"""Stored merges by buckets and the incremental harvest."""

import os
import random

from pyspark.sql import functions as F

from biblioloom.operators import corpus
from biblioloom.sources import metadata
from biblioloom.sources.stored import Versioned
from biblioloom.streaming import harvest


def page(records, token=""):
    each = "".join(f"<record><metadata><arXiv><id>{i}</id><categories>{c}</categories><created>{u}</created></arXiv></metadata></record>" for i, c, u in records)
    return f"<OAI-PMH><ListRecords>{each}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"


def test_harvest_reads_each_file_once_and_keeps_the_watermark(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", Versioned(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    folder.mkdir()
    assert harvest.next_request(store) == {"verb": "ListRecords", "metadataPrefix": "arXiv", "set": "cs"}

    def arrive(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    def run():
        harvest.harvest_into(harvest.page_stream(spark, str(folder), maxFilesPerTrigger=1), store, checkpoint).awaitTermination()
        return {r["arxiv_id"]: (r["primary_category"], r["updated"]) for r in store.read("metadata").collect()}, store.read("harvest").first().asDict()

    arrive("b.xml", page([("1", "cs.LG cs.AI", "2021-01-01"), ("2", "cs.CL", "2021-01-05"), ("bad", "", "2021-01-01")], "t"), 1000)
    arrive("a.xml", page([("1", "cs.AI", "2020-12-01")]), 2000)
    rows, counts = run()
    assert rows == {"1": ("cs.AI", "2020-12-01"), "2": ("cs.CL", "2021-01-05")}  # what came last counts
    assert counts == {"pages": 2, "empty_pages": 0, "records": 3, "watermark": "2021-01-05"}
    arrive("c.xml", page([("3", "stat.ML", "2021-02-01")]), 3000)
    arrive("d.xml", "no xml at all", 4000)
    rows, counts = run()
    assert rows == {"1": ("cs.AI", "2020-12-01"), "2": ("cs.CL", "2021-01-05"), "3": ("stat.ML", "2021-02-01")}
    assert counts == {"pages": 4, "empty_pages": 1, "records": 4, "watermark": "2021-02-01"}
    assert run() == (rows, counts)  # nothing new
    assert harvest.next_request(store)["from"] == "2021-02-01"
    batch = store.manifest()["batch"]
    again = spark.createDataFrame([("x", page([("9", "cs.LG", "2030-01-01")]), None)], "page_id string, value string, arrived timestamp")
    assert not harvest.absorb(store, again, batch) and store.read("metadata").count() == 3


def test_merges_touch_only_their_buckets(spark, tmp_path):
    """Batches of sightings equal one fold over all; a merge reads and writes the buckets of its keys alone."""
    r = random.Random(4)
    kind = "citing_id long, cited_id long, discovered_via string, is_influential boolean, intents array<string>, first_seen_at string, seq long"
    rows = [(r.randrange(12), r.randrange(12), r.choice(["BACKWARD", "FORWARD"]), r.choice([None, True, False]), r.choice([None, ["a"], ["b", "a"]]), f"t{k}", k) for k in range(150)]
    store, seen = Versioned(spark, str(tmp_path / "edges")), []

    def fold(both):
        """Stored edges are sightings too; one that is seen both ways stays so."""
        rows = both.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))
        made = corpus.merge_edges(rows)
        was = rows.where("_new = 0 and discovered_via = 'BOTH'").select("citing_id", "cited_id", F.lit(True).alias("_both"))
        made = made.join(was, ["citing_id", "cited_id"], "left").withColumn("discovered_via", F.when(F.col("_both"), "BOTH").otherwise(F.col("discovered_via"))).drop("_both")
        return made.withColumn("seq", F.lit(-1).cast("long"))

    for b in range(3):
        some = rows[b * 50 : b * 50 + 50]
        seen += some
        assert store.merge("edges", spark.createDataFrame(some, kind), ["citing_id"], fold, b, buckets=8)
        assert not store.merge("edges", spark.createDataFrame(some, kind), ["citing_id"], fold, b, buckets=8)
    order = ["citing_id", "cited_id", "discovered_via", "is_influential", "intents", "first_seen_at"]
    want = sorted(map(str, corpus.merge_edges(spark.createDataFrame(seen, kind)).select(order).collect()))
    assert sorted(map(str, store.read("edges").select(order).collect())) == want
    before = dict(store.manifest()["tables"])
    store.merge("edges", spark.createDataFrame([(3, 99, "FORWARD", None, None, "t", 999)], kind), ["citing_id"], fold, 7, buckets=8)
    changed = [k for k, f in store.manifest()["tables"].items() if before.get(k) != f]
    own = spark.range(1).select(F.pmod(F.xxhash64(F.lit(3).cast("long")), F.lit(8)).alias("b")).first()["b"]
    assert changed == [f"edges#{own}"]
    read = store.read("edges", [own]).inputFiles()
    assert read and all(f"_bucket={own}/" in f for f in read) and store.read("edges").count() == len(want) + 1
    assert store.read("nothing") is None


def test_nodes_fold_features_breakdown_and_position(spark):
    kind = "session_id long, paper_id long, state string, depth int, score double, added_by string, features map<string,double>, breakdown map<string,double>, x double, y double, seq long"
    rows = [(1, 1, "CANDIDATE", 2, 0.5, "r1", {"hub": 1.0}, {"hub": -0.6}, 3.0, 4.0, 1), (1, 1, "LIKED", 2, None, None, None, None, None, 9.0, 2), (1, 1, "LIKED", 1, None, None, {"hub": 0.5}, None, None, None, 3)]
    got = corpus.merge_nodes(spark.createDataFrame(rows[::-1], kind)).first()
    assert (got["state"], got["depth"], got["score"], got["added_by"]) == ("LIKED", 1, 0.5, "r1")
    assert (got["features"], got["breakdown"], got["x"], got["y"]) == ({"hub": 0.5}, {"hub": -0.6}, 3.0, 4.0)


def test_the_watermark_takes_one_pass(spark, tmp_path):
    (tmp_path / "lines").write_text('{"id": "1", "categories": "cs.LG x", "update_date": "2020-01-02"}\n{\n{"id": " ", "categories": "a"}\n{"id": "2", "categories": " "}\n{"id": "3", "categories": "cs.AI", "update_date": "2020-01-03"}\n')
    found = metadata.watermark(spark.read.text(str(tmp_path / "lines")))
    assert tuple(found.first()) == (2, 3, "2020-01-03")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
