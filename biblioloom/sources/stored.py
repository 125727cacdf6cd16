"""Versioned stored tables: several tables that change together, once for each batch.

A version is a folder with a Parquet folder for each table that it wrote, and a small manifest that names, for every
table, the version that holds it and the last batch that is in. A write puts its tables into a new folder first and
writes the manifest last, so a reader sees all of a batch or nothing, and a crash before the manifest leaves the version
before it. A batch id that the manifest has seen is not applied again. One writer at a time.

A table may be kept in buckets of its key (``merge``): a merge reads and writes only the buckets that its changes touch, and
the manifest goes on naming the older folders of all others.

Files go through Spark and Hadoop's file system, so the folder may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """{version, batch, tables: {name: folder}} of the newest whole version."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "batch": -1, "tables": {}}
        stream = self._fs.open(self._at(f"manifests/{versions[-1]:012d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def is_new(self, batch_id: int | None) -> bool:
        return batch_id is None or batch_id > self.manifest()["batch"]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as of now, of a bucketed one only some ``buckets`` where they are given; None where no version holds it."""
        tables = self.manifest()["tables"]
        if name in tables:
            return self.spark.read.parquet(f"{self.path}/{tables[name]}")
        held = {int(k.rsplit("#", 1)[1]): f"{self.path}/{f}" for k, f in tables.items() if k.rsplit("#", 1)[0] == name and "#" in k}
        paths = [f for b, f in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, name: str, changes: DataFrame, key: list[str], fold, batch_id: int | None = None, buckets: int = 64, also: dict[str, DataFrame] | None = None) -> bool:
        """Folds ``changes`` into a bucketed table; False where the batch is in already.

        ``fold`` gets old and new rows of the touched buckets together, with a column ``_new`` (0 and 1), and gives the rows of the
        table. ``also`` are other tables that change with it. The number of buckets belongs to the table and must stay.
        """
        if not self.is_new(batch_id):
            return False
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        fresh = self.stage(changes, batch_id, f"{name}-changes")
        touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        both, old = fresh.withColumn("_new", F.lit(1)), self.read(name, touched)
        if old is not None:
            both = old.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
        made = fold(both).withColumn("_bucket", bucket)
        folder = f"data/{self.manifest()['version'] + 1:012d}-{uuid.uuid4().hex}"
        made.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}/{name}")
        return self.commit(also or {}, batch_id, {f"{name}#{b}": f"{folder}/{name}/_bucket={b}" for b in touched})

    def stage(self, df: DataFrame, batch_id: int | None, name: str) -> DataFrame:
        """``df`` written beside the versions and read again, for results that a batch uses more than once."""
        folder = f"{self.path}/staged/{batch_id}-{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.parquet(folder)

    def commit(self, tables: dict[str, DataFrame], batch_id: int | None = None, folders: dict[str, str] | None = None) -> bool:
        """Writes the tables as one new version, with ``folders`` that are written already; False where the batch is in already."""
        now = self.manifest()
        if batch_id is not None and batch_id <= now["batch"]:
            return False
        version, written = now["version"] + 1, {}
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            written[name] = f"{folder}/{name}"
            df.write.parquet(f"{self.path}/{written[name]}")
        new = {"version": version, "batch": now["batch"] if batch_id is None else batch_id, "tables": {**now["tables"], **(folders or {}), **written}}
        draft = self._at(f"manifests/.{version:012d}-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._at(f"manifests/{version:012d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")
        if self._fs.exists(self._at("staged")):
            self._fs.delete(self._at("staged"), True)
        return True

    def replace(self, name: str, made, batch_id: int | None = None) -> bool:
        """A new version of one table: ``made(old)`` for the old table, or for None where there is none."""
        return self.is_new(batch_id) and self.commit({name: made(self.read(name))}, batch_id)

    def clean(self, keep: int = 2) -> None:
        """Removes versions but the newest ``keep``, and data that no manifest left names."""
        versions = self._versions()
        for v in versions[: max(0, len(versions) - max(1, keep))]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        named = set()
        for v in self._versions():
            stream = self._fs.open(self._at(f"manifests/{v:012d}.json"))
            try:
                named |= {f.split("/")[1] for f in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"].values()}
            finally:
                stream.close()
        if self._fs.exists(self._at("data")):
            for f in self._fs.listStatus(self._at("data")):
                if f.getPath().getName() not in named:
                    self._fs.delete(f.getPath(), True)
