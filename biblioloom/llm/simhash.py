"""Operator 3, SimHash near-duplicates by pivot distance tables.

Fingerprints: 64 bits from XXH64 (seed 42) of the 3-word shingles of a text (A-Z lower-cased); a
bit is 1 if it is set in over half of the hashes. Two texts are linked when their fingerprints
differ in at most ``RADIUS`` = 3 bits.

Links are found among distinct fingerprints, so exact copies cost one row. A pair at distance 3
agrees on at least three of six bit blocks, hence twenty keys per fingerprint deal every linked
pair to a common group. Inside a group each fingerprint has a row of Hamming distances to
``PIVOTS`` reference fingerprints; a pair with any coordinate differing by more than 3 cannot be
linked (triangle inequality) and is discarded; survivors are verified bit by bit.

Groups above ``GROUP`` rows are dealt again by twenty finer keys from the remaining bits. Those
finer groups agree on 48 bits, so they hold at most 65,536 distinct fingerprints by construction.
A group yields only the edges of a forest over its components, never all its pairs; no node has
more than three of them in a group, so no text becomes the hub of a later join; the components are
the same.

Defined results: null, empty and blank texts have no words and fingerprint 0, linked like any
other; a text of fewer than three words is one shingle; repeated rows are one node; a null doc_id
gets a fingerprint and the least doc_id of its component; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import cut, small_batches
from biblioloom.llm.components import HEAVY, connected_components, of_label, parts, tree

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Bits of the six blocks; any three of them are a key.
BLOCKS = (11, 11, 11, 11, 10, 10)
GROUP = 4096
PIVOTS = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(16)], np.uint64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    small_batches(documents.sparkSession)

    def work(batches):
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id bigint, fp bigint"
    )


def _masks(free: int, widths: tuple[int, ...]) -> list[int]:
    """Masks of consecutive set bits of ``free``, one for each width."""
    bits, out = [b for b in range(64) if free >> b & 1], []
    for w in widths:
        out.append(sum(1 << b for b in bits[:w]))
        bits = bits[w:]
    return out


def key_masks(free: int = (1 << 64) - 1, widths: tuple[int, ...] = BLOCKS) -> list[int]:
    return [sum(c) for c in combinations(_masks(free, widths), len(widths) - RADIUS)]


COARSE = key_masks()


def fine_masks(coarse: int) -> list[int]:
    """Finer keys inside a coarse one: 48 bits and more agree."""
    free = ~COARSE[coarse] & (1 << 64) - 1
    n = free.bit_count()
    widths = tuple(n // 6 + (i < n % 6) for i in range(6))
    return [COARSE[coarse] | m for m in key_masks(free, widths)]


def coarse_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint its twenty (which, bits) keys."""
    which = np.repeat(np.arange(len(COARSE), dtype=np.int32), len(fp))
    return which, np.concatenate([fp & np.uint64(m) for m in COARSE])


def distances(fp: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Hamming distances between fingerprints of one or more words (rows) and each of the others."""
    return np.bitwise_count(fp[:, None] ^ others[None]).reshape(len(fp), len(others), -1).sum(axis=2, dtype=np.int16)


def pivot_table(fp: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    return distances(fp, pivots)


def near(fp: np.ndarray, table: np.ndarray, one: int, many: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Those of ``many`` (indices) within ``radius`` of ``one``: pivot coordinates first, then the bits."""
    for p in range(0, table.shape[1], 4):
        many = many[np.abs(table[many, p : p + 4] - table[one, p : p + 4]).max(axis=1) <= radius]
        if not len(many):
            return many
    return many[distances(fp[many], fp[one : one + 1])[:, 0] <= radius]


def forest(fp: np.ndarray, radius: int = RADIUS, pivots: np.ndarray = PIVOTS, proved=None, order=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (two index arrays) that hold the linked components of one group together, by trees of degree three
    in the ``order`` of the nodes' values (of the fingerprints as signed longs, if it is not given).

    ``proved`` (one, many) may drop fingerprints that are near, but whose texts are not.
    """
    table, todo = pivot_table(fp, pivots), np.arange(len(fp))
    order = np.ascontiguousarray(fp).view(np.int64) if order is None else order
    left, right = [], []
    while len(todo) > 1:
        queue, todo = [int(todo[0])], todo[1:]
        met = list(queue)
        while queue and len(todo):
            one = queue.pop()
            found = near(fp, table, one, todo, radius)
            if proved is not None:
                found = proved(one, found)
            if len(found):
                met += found.tolist()
                queue += found.tolist()
                todo = todo[~np.isin(todo, found, assume_unique=True)]
        if len(met) > 1:
            x, y = tree(np.array(met), order)
            left.append(x)
            right.append(y)
    none = np.zeros(0, int)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def short_runs(fp: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of neighbours in sorted runs, all runs at once; for runs of a few rows."""
    table, left, right = pivot_table(fp), [], []
    d = 1
    while d < len(fp):
        i = np.flatnonzero(run[d:] == run[:-d])
        if not len(i):
            break
        for p in range(len(PIVOTS)):
            i = i[np.abs(table[i + d, p] - table[i, p]) <= RADIUS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
        left.append(i)
        right.append(i + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


#: Runs of up to so many rows are compared by offsets, longer ones by a search that spans them.
SHORT = 48
LINKS = "x bigint, y bigint, which int"


def _links(x=(), y=(), which=None) -> pa.RecordBatch:
    x, y = (np.ascontiguousarray(a, np.uint64).view(np.int64) if len(a) else np.zeros(0, np.int64) for a in (x, y))
    which = np.full(len(x), -1, np.int32) if which is None else which
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(which, pa.int32())], names=["x", "y", "which"])


def _search(limit: int | None):
    """Over batches (which, bits, fp) sorted by key: links, and rows of runs beyond ``limit`` as (fp, fp, which)."""

    def work(batches):
        held: list[np.ndarray] = []  # columns which, bits, fp of the run that may go on
        deferred = None

        def settle(which, bits, fp):
            new = np.flatnonzero((which[1:] != which[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(fp)]
            sizes = ends - starts
            small = (sizes > 1) & (sizes <= SHORT)
            rows = np.repeat(small, sizes)
            if rows.any():
                run = np.repeat(np.arange(len(sizes)), sizes)[rows]
                own = fp[rows]
                i, j = short_runs(own, run)
                yield _links(own[i], own[j])
            for s, e in zip(starts[sizes > SHORT].tolist(), ends[sizes > SHORT].tolist(), strict=True):
                own = fp[s:e]
                i, j = forest(own)
                if len(i):
                    yield _links(own[i], own[j])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cols[1], cols[2] = cols[1].view(np.uint64), cols[2].view(np.uint64)
            if deferred is not None:
                same = (cols[0] == deferred[0]) & (cols[1] == deferred[1])
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    yield _links(cols[2][:n], cols[2][:n], cols[0][:n])
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                deferred = None
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            # the last run may go on in the next batch
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            at = len(last) if not last.any() else int(last.argmax())
            if limit is not None:
                change = np.flatnonzero((cols[0][1:at] != cols[0][: max(at - 1, 0)]) | (cols[1][1:at] != cols[1][: max(at - 1, 0)])) + 1
                starts, ends = np.r_[0, change].astype(int), np.r_[change, at].astype(int)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    if e - s > limit:
                        yield _links(cols[2][s:e], cols[2][s:e], cols[0][s:e])
                keep = np.repeat(ends - starts <= limit, ends - starts) if at else np.zeros(0, bool)
                done = [c[:at][keep] for c in cols]
            else:
                done = [c[:at] for c in cols]
            if len(done[0]):
                yield from settle(*done)
            held = [c[at:] for c in cols]
            if limit is not None and len(held[0]) > limit:
                deferred = (held[0][0], held[1][0])
                yield _links(held[2], held[2], held[0])
                held = []
        if held and len(held[0]):
            yield from settle(*held)
        yield _links()

    return work


def _grouped(rows: DataFrame, limit: int | None) -> DataFrame:
    """Search in groups; the key columns deal and sort the rows."""
    return rows.repartition("which", "bits").sortWithinPartitions("which", "bits").mapInArrow(_search(limit), LINKS)


def links(distinct: DataFrame) -> DataFrame:
    """(x, y) edges between distinct fingerprints (column fp) whose components are those of all links."""

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            which, bits = coarse_keys(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which), pa.array(bits.view(np.int64)), pa.array(np.tile(fp, len(COARSE)).view(np.int64))],
                names=["which", "bits", "fp"],
            )

    def refine(batches):
        for batch in batches:
            fp, coarse = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy()
            for c in np.unique(coarse).tolist():
                own = fp[coarse == c]
                for f, mask in enumerate(fine_masks(c)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(own), 32 * c + f, np.int32)),
                            pa.array((own & np.uint64(mask)).view(np.int64)),
                            pa.array(own.view(np.int64)),
                        ],
                        names=["which", "bits", "fp"],
                    )

    keyed = "which int, bits bigint, fp bigint"
    first = cut(_grouped(distinct.select("fp").mapInArrow(spread, keyed), GROUP))
    found = first.where("which < 0").select("x", "y")
    deferred = first.where("which >= 0")
    if deferred.isEmpty():
        return found
    again = deferred.select(F.col("x").alias("fp"), F.col("which").alias("coarse")).mapInArrow(refine, keyed)
    return found.unionByName(cut(_grouped(again, None)).select("x", "y"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``documents``."""
    marked = cut(fingerprints(documents))
    n = parts(marked.count())
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).coalesce(n))
    labels = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    joined = labels.join(distinct, "fp")
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    # a fingerprint without links is its own component; only linked ones carry a label
    linked = of_label(labels, least, labels.count()).select("fp", "component_id", F.lit(True).alias("_linked"))
    named = distinct.join(linked, "fp", "left").select("fp", "rows", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    named = cut(named.coalesce(n))
    # a fingerprint that many rows carry goes to them instead of them to it; there are at most HEAVY of these
    often = named.where(F.col("rows") > F.lit(named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] // HEAVY)).drop("rows")
    few = marked.join(F.broadcast(often), "fp", "left_anti").join(named.drop("rows"), "fp")
    told = few.unionByName(marked.join(F.broadcast(often), "fp"))
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
