"""Operator 2, benchmark decontamination by latent semantic retrieval.

1. Every text becomes the sequence of its words' numbers in the benchmark's vocabulary (-1: not
   in it), once, in the shared folder; later passes read numbers only.
2. Document frequencies of that vocabulary over all texts give the TF-IDF weights; words in over
   ``COMMON`` of the texts weigh nothing, but for items that consist mainly of such words.
3. A randomised SVD of TF-IDF passages (of all benchmark items and all texts) gives ``RANK`` latent directions:
   one pass sums the sketch A'(A Omega) over the executors by term and the small matrix (A Omega)'(A Omega)
   with it; both give the leading right singular directions (Nystroem's form of the randomised SVD).
4. Every passage of every text (``WINDOW`` words, starting every ``STEP`` words) is compared with
   every item, or every window of an item of over ``LONG`` words, by the cosine in the latent space;
   those of ``MIN_COSINE`` and more are candidates.
5. A candidate counts if the longest common subsequence of the item and the words around the
   passage covers ``COPY`` of the item, or ``PARAPHRASE`` of it and ``ANSWER`` of the item's
   answer (its last sentence). Before that, candidates go whose surroundings hold too few of the
   item's words to reach ``PARAPHRASE`` in any order; this bound is exact and loses nothing.

A passage equal to an item has cosine 1 if the item lies in the latent space at all; items of which less
than ``SEEN`` does add their own remainder as a direction. Items are handled in blocks of up to ``ITEMS`` and ``BLOCK_WORDS`` words that fit a
broadcast; each block has its own vocabulary, weights and space.

Defined results: null or empty texts and items match nothing, nor do items of fewer than ``LEAST`` words,
which any text may hold by chance; repeated rows give one result; rows of ``documents`` without doc_id are
searched and reported with a null id; an empty benchmark or empty documents give no rows; items with
equal texts are each reported. ``decontaminate`` goes by the text of a row, not by its doc_id, so of rows
that share a doc_id (or have none) just those that hold an item go; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import cut, small_batches

RANK, OVERSAMPLE = 96, 8
WINDOW, STEP, MIN_COSINE = 32, 16, 0.45
LONG = 48  # items of more words are searched by their own windows
COMMON, FLOOR, FEW = 0.2, 0.1, 5
COPY, PARAPHRASE, ANSWER = 0.7, 0.6, 0.8
#: Bits of a passage's word set, and words of the longest items that are weighed by it before the comparison.
BUCKETS, REACH = 1024, 128
ITEMS, BLOCK_WORDS = 20_000, 2_000_000
LEAST, SEEN = 3, 0.02
KNOWN_WORDS = 500_000
#: Words whose rows are gathered at once.
SLICE = 1 << 13
EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SCHEMA = (
    "doc_id bigint, item_id bigint, cosine double, lcs_words bigint, item_words bigint, lcs_share double, answer_found boolean"
)


def words_of(text: str | None) -> list[bytes]:
    return [w.strip(EDGE) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def answer_of(text: str) -> int:
    """How many words the last sentence of an item has."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    return len(parts[-1].split()) if parts else 0


class Numbers(dict):
    """Numbers of words as they stand in a text; remembers a bounded count of them."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        n = self[word] = self.vocabulary.get(word.strip(EDGE), -1)
        return n


def numbered(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids): the word numbers of each text as little-endian 16- or 32-bit integers."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = width(len(vocabulary))

    def work(batches):
        get = Numbers(shared.value).__getitem__
        for batch in batches:
            ids = [
                np.fromiter(map(get, (t or "").encode("utf-8", "surrogatepass").lower().split()), kind).tobytes()
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id bigint, ids binary"
    )


def width(n_words: int) -> str:
    return "<i2" if n_words < 1 << 15 else "<i4"


def document_frequencies(ids: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """How many texts hold each word, and how many texts there are; sums over all of them."""
    kind = width(n_words)

    def work(batches):
        found, rows = np.zeros(n_words, np.int64), 0
        for batch in batches:
            for raw in batch.column(0):
                own = np.unique(np.frombuffer(raw.as_py(), kind))
                found[own[own >= 0]] += 1
                rows += 1
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, terms].astype(np.int32)), pa.array(np.r_[rows, found[terms]])], names=["term", "n"]
        )

    rows = ids.select("ids").mapInArrow(work, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_words, np.int64)
    total = 0
    for r in rows:  # at most one row for each word of the benchmark's vocabulary
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, total


def inverse_frequencies(counts: np.ndarray, total: int, items: list[np.ndarray]) -> np.ndarray:
    """Weights of the words; an item of mainly common words keeps a small weight for each of them."""
    idf = np.log((COMMON * total + 1) / (counts + 0.5)).clip(min=0).astype(np.float32)
    weak = [own[own >= 0] for own in items if (n := (idf[own[own >= 0]] > 0).sum()) < FEW or 2 * n < len(own)]
    for own in weak:
        idf[own] = np.maximum(idf[own], FLOOR)
    return idf


def weighing(idf: np.ndarray) -> np.ndarray:
    """Which words weigh something; the last entry stands for -1, a foreign word."""
    return np.append(idf > 0, False)


def passages(ids: np.ndarray, weights: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``weights`` (one for each word) over the windows of a text."""
    at = live[ids].nonzero()[0]
    n = max(1, -(-len(ids) // STEP))
    steps = np.zeros((n, weights.shape[1]), np.float32)
    if len(at):
        cell = at // STEP
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(cell[1:], cell[:-1], out=new[1:])
        first = new.nonzero()[0]
        steps[cell[first]] = np.add.reduceat(weights[ids[at]], first, axis=0)
    out = steps.copy()
    for d in range(1, WINDOW // STEP):
        out[: max(0, n - d)] += steps[d:]
    return out


def _sketch(texts: list[np.ndarray], idf: np.ndarray, live: np.ndarray, basis: np.ndarray, into: np.ndarray, core: np.ndarray) -> None:
    """Adds A'(A basis) of some texts to ``into`` and (A basis)'(A basis) to ``core``."""
    per = WINDOW // STEP
    sizes = np.array([max(1, -(-len(t) // STEP)) + per - 1 for t in texts])  # empty steps keep texts apart
    ends = np.cumsum(sizes)
    found = [live[t].nonzero()[0] for t in texts]
    words = np.concatenate([t[at] for t, at in zip(texts, found, strict=True)])
    cells = np.concatenate([at // STEP + base for at, base in zip(found, ends - sizes, strict=True)])
    steps = np.zeros((ends[-1], basis.shape[1]), np.float32)
    for s in range(0, len(words), SLICE):
        cell = cells[s : s + SLICE]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        steps[cell[first]] += np.add.reduceat(basis[words[s : s + SLICE]], first, axis=0)
    z = steps.copy()
    for d in range(1, per):
        z[:-d] += steps[d:]
        z[ends - d] = 0
    core += z.T @ z
    total = z.copy()  # the windows that a step lies in
    for d in range(1, per):
        total[d:] += z[:-d]
    for s in range(0, len(words), SLICE):
        word = words[s : s + SLICE]
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
        own = word[order][first]
        into[own] += idf[own, None] * np.add.reduceat(total[cells[s : s + SLICE][order]], first, axis=0)


def _sketched(texts, idf: np.ndarray, live: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``_sketch`` over any number of texts, some at a time."""
    into, core = np.zeros((len(idf), basis.shape[1])), np.zeros((basis.shape[1],) * 2)
    some, n = [], 0
    for ids in texts:
        if len(ids):
            some.append(ids)
            n += len(ids)
        if n >= SLICE:
            _sketch(some, idf, live, basis, into, core)
            some, n = [], 0
    if some:
        _sketch(some, idf, live, basis, into, core)
    return into, core


def latent_space(texts: DataFrame, items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Vocabulary x RANK: the leading right singular directions of the TF-IDF passages of ``texts`` and ``items``."""
    n_words = len(idf)
    k = min(n_words, RANK + OVERSAMPLE)
    omega = np.random.default_rng(7).standard_normal((n_words, k)).astype(np.float32)
    kind = width(n_words)
    first = (idf[:, None] * omega).astype(np.float32)
    sent = texts.sparkSession.sparkContext.broadcast((idf, weighing(idf), first))

    def partial(batches):
        into, core = _sketched((np.frombuffer(raw.as_py(), kind) for batch in batches for raw in batch.column(0)), *sent.value)
        terms = np.flatnonzero(into.any(axis=1))
        rows = [core.astype(np.float32).tobytes(), *(r.tobytes() for r in into[terms].astype(np.float32))]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, terms].astype(np.int32)), pa.array(rows, pa.binary())], names=["term", "row"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[term] = total.get(term, 0) + np.frombuffer(row, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())],
            names=["term", "row"],
        )

    kinds = "term int, row binary"
    sketch, core = _sketched(items, idf, weighing(idf), first)
    for r in texts.select("ids").mapInArrow(partial, kinds).repartition(8, "term").mapInArrow(summed, kinds).toLocalIterator():
        if r["term"] < 0:
            core += np.frombuffer(r["row"]).reshape(k, k)
        else:
            sketch[r["term"]] += np.frombuffer(r["row"])
    values, vectors = np.linalg.eigh(core)
    held = values > 1e-7 * values.max()
    space = np.linalg.svd(sketch @ (vectors[:, held] / np.sqrt(values[held])), full_matrices=False)[0][:, :RANK]
    lost = []
    for ids in items:
        own = np.zeros(n_words)
        np.add.at(own, ids[ids >= 0], idf[ids[ids >= 0]])
        if np.linalg.norm(space.T @ own) < SEEN * np.linalg.norm(own):
            lost.append(own)
    if lost:
        rest = np.stack(lost, axis=1)
        more, sizes, _ = np.linalg.svd(rest - space @ (space.T @ rest), full_matrices=False)
        space = np.concatenate([space, more[:, sizes > 1e-6 * max(sizes)]], axis=1)
    return space.astype(np.float32)


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bits; ``masks`` hold an item's positions of each word."""
    v = full = (1 << length) - 1
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return length - v.bit_count()


def positions(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Item:
    def __init__(self, item_id: int, text: str, vocabulary: dict[bytes, int]):
        ids = [vocabulary.get(w, -1) for w in words_of(text)]
        self.item_id, self.ids = item_id, np.array(ids, np.int32)
        self.words = [i for i in ids if i >= 0]
        n = sum(i >= 0 for i in ids[len(ids) - answer_of(text) :]) if ids else 0
        self.answer = self.words[len(self.words) - n :]
        self.masks, self.answer_masks = positions(self.words), positions(self.answer)

    def compare(self, region: list[int]) -> tuple[bool, int, bool]:
        """(counts, words in common, whether the answer is there)."""
        region = [w for w in region if w in self.masks]
        if len(region) < PARAPHRASE * len(self.words):
            return False, 0, False
        n = lcs(self.masks, len(self.words), region)
        answered = not self.answer or lcs(self.answer_masks, len(self.answer), region) >= ANSWER * len(self.answer)
        share = n / len(self.words)
        return share >= COPY or share >= PARAPHRASE and answered, n, answered


def bucket(words: np.ndarray) -> np.ndarray:
    """Bits of words in a set; bit 0 stays free."""
    return 1 + words % (BUCKETS - 1)


class Bound:
    """How many words of an item can lie around a passage, from above: the check before the subsequence."""

    def __init__(self, items: list[Item]):
        short = [len(i.ids) <= REACH for i in items]
        self.cells = -(-max((len(i.ids) for i, s in zip(items, short, strict=True) if s), default=0) // STEP)
        self.spots = np.zeros((len(items), max((len(i.words) for i, s in zip(items, short, strict=True) if s), default=1)), np.int32)
        self.need = np.zeros(len(items))  # longer items are compared without this check
        for j, item in enumerate(items):
            if short[j]:
                self.spots[j, : len(item.words)] = bucket(np.array(item.words, np.int32))
                self.need[j] = PARAPHRASE * len(item.words) - 1e-6

    def sets(self, words: np.ndarray, cell: np.ndarray, start: int, stop: int) -> np.ndarray:
        """For the passages from ``start`` to ``stop`` the bits of all words that a comparison may read.

        ``cell`` (ascending) is the passage that starts nearest before each word.
        """
        low, high = max(0, start - self.cells), stop + self.cells + WINDOW // STEP
        a, b = np.searchsorted(cell, (low, high))
        near, own = cell[a:b] - low, words[a:b]
        inside = own >= 0
        held = np.zeros((high - low, BUCKETS), bool)
        held[near[inside], bucket(own[inside].astype(np.int32))] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        out = np.zeros((stop - start, bits.shape[1]), np.uint64)
        for d in range(-self.cells, self.cells + WINDOW // STEP):
            first = max(0, start + d - low)
            part = bits[first : max(first, stop + d - low)]
            out[len(out) - len(part) :] |= part
        return np.unpackbits(out.view(np.uint8), axis=1)

    def reached(self, sets: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which (passage, item) candidates can still count."""
        flat, out = sets.ravel(), np.empty(len(passage), bool)
        for s in range(0, len(passage), 1 << 14):
            p, j = passage[s : s + (1 << 14)], item[s : s + (1 << 14)]
            out[s : s + len(p)] = flat[(p * BUCKETS)[:, None] + self.spots[j]].sum(axis=1, dtype=np.int32) >= self.need[j]
        return out


def search(ids: DataFrame, items: list[Item], idf: np.ndarray, space: np.ndarray) -> DataFrame:
    """Contaminated (doc_id, item_id) pairs with their figures."""
    kind = width(len(idf))
    weights = (idf[:, None] * space).astype(np.float32)
    parts, owner = [], []
    for j, item in enumerate(items):
        n = len(item.ids)
        for at in range(0, max(1, n - STEP), STEP) if n > LONG else (0,):
            own = item.ids[at : at + WINDOW] if n > LONG else item.ids
            parts.append(weights[own[own >= 0]].sum(axis=0))
            owner.append(j)
    heads = np.stack(parts)
    heads /= np.maximum(np.linalg.norm(heads, axis=1, keepdims=True), 1e-9)
    sent = ids.sparkSession.sparkContext.broadcast(
        (items, np.array(owner), Bound(items), weights, weighing(idf), np.ascontiguousarray(heads.T))
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def work(batches):
        items, owner, bound, weights, live, heads = sent.value
        chunk = max(64, (4 << 20) // heads.shape[1])
        for batch in batches:
            found: dict[tuple, tuple] = {}
            waiting, pending = 0, []

            def flush():
                nonlocal pending, waiting
                if not pending:
                    return
                p = np.concatenate([z for _, z in pending])
                row = np.repeat(np.arange(len(pending)), [len(z) for _, z in pending])
                base = np.cumsum([0, *(len(z) for _, z in pending)])
                norm = np.linalg.norm(p, axis=1, keepdims=True)
                p = p / np.maximum(norm, 1e-9)
                cell = np.concatenate([b + np.arange(len(own)) // STEP for b, ((_, own), _) in zip(base, pending, strict=False)])
                words = np.concatenate([own for (_, own), _ in pending])
                for s in range(0, len(p), chunk):
                    c = p[s : s + chunk] @ heads
                    near, head = np.nonzero(c >= MIN_COSINE)
                    sets = bound.sets(words, cell, s, s + len(c))
                    able = bound.reached(sets, near, owner[head])
                    for w, h, j in zip(near[able].tolist(), head[able].tolist(), owner[head[able]].tolist(), strict=True):
                        r = int(row[s + w])
                        doc, own = pending[r][0]
                        item = items[j]
                        key = (r, doc, j)
                        if key in found:
                            continue
                        at = (s + w - int(base[r])) * STEP
                        n = len(item.ids)
                        region = own[max(0, at - n) : at + WINDOW + n].tolist()
                        counts, common, answered = item.compare(region)
                        if counts:
                            found[key] = (
                                doc, item.item_id, float(c[w, h]), common, len(item.words), common / len(item.words), answered,
                            )
                out.extend(found.values())
                found.clear()
                pending, waiting = [], 0

            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_py(), kind)
                if not len(own):
                    continue
                z = passages(own, weights, live)
                pending.append(((doc, own), z))
                waiting += len(z)
                if waiting >= 8192:
                    flush()
            flush()
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return ids.mapInArrow(work, SCHEMA)


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each text and benchmark item that it holds."""
    spark = documents.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    n, n_words = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    blocks = max(-(-n // ITEMS), -(-n_words // BLOCK_WORDS))
    result = spark.createDataFrame([], SCHEMA)
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        own.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        vocabulary = {w: i for i, w in enumerate(sorted({w for r in own for w in words_of(r["text"]) if w}))}
        items = [i for i in (Item(r["item_id"], r["text"], vocabulary) for r in own) if len(i.words) >= LEAST]
        if not items:
            continue
        ids = cut(numbered(documents, vocabulary))
        counts, total = document_frequencies(ids, len(vocabulary))
        for i in items:  # the items are passages of the collection too
            counts[np.unique(i.words)] += 1
        idf = inverse_frequencies(counts, total + len(items), [i.ids for i in items])
        space = latent_space(ids, [i.ids for i in items], idf)
        result = result.unionByName(search(ids, items, idf, space))
    return (
        result.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("lcs_words", "cosine", "item_words", "lcs_share", "answer_found")).alias("best"))
        .select("doc_id", "item_id", *[f"best.{c}" for c in ("cosine", "lcs_words", "item_words", "lcs_share", "answer_found")])
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text holds no benchmark item, with all their columns.

    The rows travel as one struct, so no column name of theirs can meet one of this operator.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    leaks = find_leaks(documents.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_key")).distinct()
    rows = documents.select(key.alias("_key"), F.struct(*[documents[c] for c in documents.columns]).alias("_row"))
    return rows.join(leaks, "_key", "left_anti").select("_row.*")
