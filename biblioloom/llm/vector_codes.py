"""Operator 11, vector code compression: product codes by integer k-means.

Each component becomes ``floor(scale * x)``, a vector is cut into equal consecutive parts, and each part
is named by its nearest codebook entry. Rows travel as columnar NumPy blocks (one array of integers for
each dimension). In every round an RDD ``treeAggregate`` goes over the blocks: distances to all entries
of a part accumulate dimension by dimension, ``np.add.at`` adds rows to int64 tensors of sums and counts,
and a reduction tree merges the tensors. A tensor has the fixed size parts x width x entries, so neither
a task nor the driver holds more than one block and two tensors, whatever the number of rows. Sums are
integers: the order in which tasks or repeated tasks deliver them changes nothing.

Codebooks start as the parts of the ``entries`` rows with the smallest ids. All rows take part in every
round; nothing is sampled.

Defined results: a vector that is null, or has a null or non-finite component, is dropped; so is one with a
component of 2**19 or more in magnitude (its squared distances may leave 64 bits), one that cannot be cut into
equal parts, and one of another length than the vector of the smallest id left. Repeated rows count and are
returned each; of equal ids the lesser vector comes first; null ids come last. Fewer rows than entries make
smaller codebooks. A null label is a label of its own; ``label_error`` is null where it leaves 64 bits. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import cut, small_batches
from biblioloom.llm.components import of_label

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from here on would not leave room for squared distances in 64 bits.
LIMIT = float(2**19)
#: Partitions above which the tree of ``treeAggregate`` gets a third level.
WIDE = 1_000


def whole_vectors(rows: DataFrame, column: str = "embedding", keep: tuple = ("vec_id", "label"), parts: int = PARTS, limit: float = LIMIT) -> DataFrame:
    """``keep`` and the vector as ``_x`` (doubles) of the rows that take part, but for the common length."""
    x = rows[column].cast("array<double>")
    fine = (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    return rows.select(*[rows[k] for k in keep], x.alias("_x")).where(F.coalesce(fine, F.lit(False)))


def integers(values: pa.Array, width: int) -> np.ndarray:
    """A list column as integers, a row for each dimension."""
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.ascontiguousarray(np.floor(x * SCALE).astype(np.int64).T)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry; ties go to the lower index. ``part`` (width, rows), ``book`` (width, entries)."""
    far = np.zeros((book.shape[1], part.shape[1]), np.int64)
    for x, entry in zip(part, book, strict=True):
        step = x[None, :] - entry[:, None]
        far += step * step
    code = far.argmin(axis=0)
    return code, far[code, np.arange(part.shape[1])]


def blocks_of(vectors: DataFrame, width: int) -> RDD:
    """The vectors as an RDD of arrays (dimensions, rows)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([integers(b.column(0), width).astype(np.int32).tobytes()], pa.binary())], ["block"])

    return vectors.select("_x").mapInArrow(pack, "block binary").rdd.map(lambda r: np.frombuffer(r[0], np.int32).reshape(width, -1).astype(np.int64))


def refine(blocks: RDD, books: np.ndarray) -> np.ndarray:
    """``books`` (parts, width, entries) after one round over all blocks; entries that nobody uses stay."""
    parts, width, entries = books.shape

    def add(acc, block: np.ndarray):
        sums, counts = acc or (np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64))
        for p in range(parts):
            own = block[p * width : (p + 1) * width]
            code, _ = nearest(own, books[p])
            np.add.at(counts[p], code, 1)
            for j in range(width):
                np.add.at(sums[p, j], code, own[j])
        return sums, counts

    def merge(one, other):
        if one is None or other is None:
            return other if one is None else one
        return one[0] + other[0], one[1] + other[1]

    found = blocks.treeAggregate(None, add, merge, depth=3 if blocks.getNumPartitions() > WIDE else 2)
    if found is None:
        return books
    sums, counts = found
    used = (counts > 0)[:, None, :]
    return np.where(used, sums // np.maximum(counts, 1)[:, None, :], books)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, width, entries) of ``whole_vectors``; None where there are no rows."""
    small_batches(vectors.sparkSession)
    first = lambda rows: [r["_x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "_x").select("_x").limit(entries).collect()]
    seeds = first(vectors)
    if not seeds:
        return None
    size = len(seeds[0])
    if any(len(s) != size for s in seeds):
        seeds = first(vectors.where(F.size("_x") == size))
    start = np.floor(np.array(seeds) * SCALE).astype(np.int64)  # rows of the smallest ids
    books = np.ascontiguousarray(start.reshape(len(seeds), parts, size // parts).transpose(1, 2, 0))
    blocks = blocks_of(vectors.where(F.size("_x") == size), size)
    for _ in range(rounds):
        books = refine(blocks, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The kept columns of ``whole_vectors`` with ``code`` (two hex digits a part) and ``error`` (squared distance)."""
    parts, width, _ = books.shape
    size = parts * width
    keep = [c for c in vectors.columns if c != "_x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("_x"), size)
            found = [nearest(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            error = sum((far for _, far in found), np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], [*keep, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "_x")
    return vectors.where(F.size("_x") == size).mapInArrow(run, f"{schema}, code string, error long")


def listing(books: np.ndarray) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(map(str, books.transpose(0, 2, 1).ravel().tolist()))


def compress(embeddings: DataFrame) -> DataFrame:
    """Codes and errors of all rows, the error of each label, and the digest of the codebooks.

    The coded rows are stored once; a label that very many rows share gets its sum by a broadcast of at
    most 64 sums, so no task meets all of its rows.
    """
    vectors = whole_vectors(embeddings)
    books = fit(vectors)
    if books is None:
        empty = vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    coded = cut(encode(vectors, books).select("vec_id", "code", "error", key.alias("label")))
    sums = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    digest = hashlib.sha256(listing(books).encode()).hexdigest()
    return of_label(coded, sums, coded.count()).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rows for DuckDB."""
    far = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"

    def step(k: int) -> str:
        return f"""
near{k} AS (SELECT a.n, a.p, min({{'far': {far}, 'e': b.e}}) AS best FROM part a JOIN book{k} b ON a.p = b.p GROUP BY a.n, a.p)"""

    def book(k: int) -> str:
        return f"""
book{k + 1} AS (SELECT o.p, o.e, coalesce(m.x, o.x) AS x FROM book{k} o LEFT JOIN (
    SELECT p, e, list(CAST(floor(total / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY j) AS x FROM (
      SELECT p, e, j, sum(v) AS total, count(*) AS n FROM (
        SELECT a.p, c.best.e AS e, unnest(range(1, len(a.x) + 1)) AS j, unnest(a.x) AS v FROM part a JOIN near{k} c ON a.n = c.n AND a.p = c.p)
      GROUP BY p, e, j) GROUP BY p, e) m ON m.p = o.p AND m.e = o.e)"""

    rounds = ",".join(step(k) + "," + book(k) for k in range(ROUNDS))
    return f"""
WITH fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {LIMIT})) = len(embedding)),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS n FROM fine),
part AS (
  SELECT n, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x
  FROM (SELECT n, v, unnest(range({PARTS})) AS p FROM kept)),
book0 AS (SELECT p, n - 1 AS e, x FROM part WHERE n <= {ENTRIES}),{rounds},{step(ROUNDS)},
coded AS (SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY n),
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (
  SELECT p, e, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM book{ROUNDS}))
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN coded c ON c.n = k.n, digest d"""
