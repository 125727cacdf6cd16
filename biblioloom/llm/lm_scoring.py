"""Operator 5, stupid-backoff scores of every text under the trigram model of all other texts.

S(w | u v) = c(u v w) / c(u v) if that trigram occurs, else ``BACKOFF`` * c(v w) / c(v) if that bigram does,
else ``BACKOFF`` squared * c(w) / N. Counts are those of the whole corpus as they are, less what the text
itself adds (else no n-gram of a text would ever be unseen); a word that no other text has counts once.
Two start marks stand before a text, whose count is the number of texts with words.

The counting is relational: texts are dealt to batches of ``BATCH_BYTES``; a batch asks once for each distinct
n-gram, with its own count (so even the most common one costs a row for each batch, not for each text);
requests are partitioned by n-gram hash, where equal keys are summed; the totals go back and join
the batch, which sums the scores of its texts. A trigram lies with its last two words, so one partition
counts both, and the context of a word is the bigram of the word before it: a text asks for one trigram a word.

A bigram is a 64-bit hash whose first byte is the upper part of the partition number, a trigram its
bigram and 32 bits of its first word. Two bigrams share a count with a chance of 3 in 100 among 10**9.

Defined results: null and empty texts have no words, a score of 0 and no perplexity; repeated rows
are counted and scored each (a second copy is another text); a null doc_id stays null; an empty table
gives no rows; the only text of a table has nothing to be scored by but the unseen word; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import small_batches

BACKOFF = 0.4
#: Text of one batch: what a task holds in memory at once, besides one text.
BATCH_BYTES = 14 << 20
#: Batches of a small table, so that its tasks are still shared out.
BATCHES = 8
SCHEMA = "doc_id bigint, n_words bigint, n_backed_off bigint, n_unseen bigint, log_score double, perplexity double"
ASK = "part int, rank int, batch int, keys binary, groups binary, tags binary, counts binary"
TOLD = "batch int, rank int, part int, totals binary, more binary"
START, ALL = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\0start", b"\0all"))
MIX = np.uint64(0x9E3779B97F4A7C15)


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of word pairs from the hashes of their words."""
    x = (left ^ (right * MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32)) ^ (left << np.uint64(1))


def planes(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of whole numbers, first all last bytes: what is alike compresses."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def whole(raw: bytes, width: int) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, :width] = own.T
    return out.view("<u8").ravel()


class Batch:
    """The words of some texts as hashes, and the distinct n-grams in them."""

    def __init__(self, texts: list[str | None]):
        known: dict[bytes, int] = {}
        digest = xxhash.xxh64_intdigest
        parts = []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        del parts, known
        before, first = np.empty_like(words), np.empty_like(words)
        before[1:], first[2:] = words[:-1], words[:-2]
        before[starts] = START
        first[starts] = START
        first[(starts + 1)[self.sizes[self.sizes > 0] > 1]] = START
        one, n1 = np.unique(np.r_[words, START, ALL], return_inverse=True)
        self.one, self.word = one, n1[:-2].astype(np.int32)
        counts = np.bincount(n1, minlength=len(one))
        self.start, self.all = int(n1[-2]), int(n1[-1])
        del n1
        counts[self.start], counts[self.all] = len(starts), len(words)
        self.n1 = counts
        self.before = np.searchsorted(one, before).astype(np.int32)
        self.two, pair = np.unique(pairs(before, words), return_inverse=True)
        self.pair = pair.astype(np.int32)
        tag = (first * MIX) >> np.uint64(32)
        del words, before, first
        three, tri, self.n3 = np.unique((pair.astype(np.uint64) << np.uint64(32)) | tag, return_inverse=True, return_counts=True)
        self.triple = tri.astype(np.int32)
        self.tags = three & np.uint64(0xFFFFFFFF)
        #: how many trigrams each bigram has
        self.groups = np.bincount((three >> np.uint64(32)).astype(np.int64), minlength=len(self.two))

    def asked(self, bits: int):
        """Requests (part, rank, keys, groups, tags, counts)."""
        for s, e, part in _parts(self.one, bits):
            yield part, 1, planes(self.one[s:e], 7), b"", b"", planes(self.n1[s:e], 4)
        ends = np.r_[0, np.cumsum(self.groups)]
        for s, e, part in _parts(self.two, bits):
            a, b = int(ends[s]), int(ends[e])
            yield part, 2, planes(self.two[s:e], 7), planes(self.groups[s:e], 4), planes(self.tags[a:b], 4), planes(self.n3[a:b], 4)

    def scores(self, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> list[tuple]:
        """Figures of each text from the totals of the distinct n-grams."""
        out, e = [], 0
        others, starts = int(one[self.all]), float(one[self.start]) - 1
        for size in self.sizes.tolist():
            if not size:
                out.append((0, 0, 0, 0.0, None))
                continue
            s, e = e, e + size
            own = _counts(self.word[s:e])
            c1 = one[self.word[s:e]].astype(np.float64) - own
            c2 = two[self.pair[s:e]].astype(np.float64) - _counts(self.pair[s:e])
            c3 = three[self.triple[s:e]].astype(np.float64) - _counts(self.triple[s:e])
            context = one[self.before[s:e]].astype(np.float64)
            context[0] -= 1
            context[1:] -= own[:-1]
            rest = others - size  # words of other texts
            above = np.r_[starts, c2[:-1]]  # how often the two words before occur
            with np.errstate(divide="ignore", invalid="ignore"):
                unseen = np.where(c1 > 0, c1 / max(rest, 1), 1 / (rest + 1))
                logs = np.where(c3 > 0, np.log(c3 / above), np.where(c2 > 0, np.log(BACKOFF * c2 / context), np.log(BACKOFF**2 * unseen)))
            total = float(logs.sum())
            out.append((size, int((c3 <= 0).sum()), int((c1 <= 0).sum()), round(total, 6), round(float(np.exp(-total / size)), 6)))
        return out


def _counts(values: np.ndarray) -> np.ndarray:
    """How often each value occurs among all of them."""
    _, same, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[same]


def _parts(keys: np.ndarray, bits: int):
    """Runs (from, to, part) of sorted keys with equal upper bits."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    return [(s, e, int(part[s])) for s, e in zip(new.tolist(), [*new[1:].tolist(), len(keys)], strict=False)]


def totals(rank: int, held: list[tuple]) -> list[tuple[bytes, bytes]]:
    """For each request (batch, keys, groups, tags, counts) of one part the totals of its keys, and of its trigrams."""
    keys = np.concatenate([whole(k, 7) for _, k, _, _, _ in held])
    counts = np.concatenate([whole(c, 4) for *_, c in held]).astype(np.float64)
    _, same = np.unique(keys, return_inverse=True)
    sizes = [len(k) // 7 for _, k, _, _, _ in held]
    if rank == 1:
        total = np.bincount(same, weights=counts)[same].astype("<u8")
        return [(planes(x, 8), b"") for x in np.split(total, np.cumsum(sizes)[:-1])]
    groups = np.concatenate([whole(g, 4) for _, _, g, _, _ in held]).astype(np.int64)
    wide = np.repeat(same, groups)
    total = np.bincount(wide, weights=counts)[same].astype("<u8")
    tags = np.concatenate([whole(t, 4) for _, _, _, t, _ in held])
    _, triple = np.unique((wide.astype(np.uint64) << np.uint64(32)) | tags, return_inverse=True)
    three = np.bincount(triple, weights=counts)[triple].astype("<u8")
    more = [len(t) // 4 for _, _, _, t, _ in held]
    both = zip(np.split(total, np.cumsum(sizes)[:-1]), np.split(three, np.cumsum(more)[:-1]), strict=True)
    return [(planes(x, 8), planes(y, 8)) for x, y in both]


def score(documents: DataFrame) -> DataFrame:
    """Words, words scored by a shorter context, words of no other text, log score and perplexity of every row."""
    small_batches(documents.sparkSession)
    size = documents.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    batches = max(BATCHES, -(-size // BATCH_BYTES))
    bits = max(8, (4 * batches - 1).bit_length())  # parts of the key space grow with the input
    spread = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(batches)).cast("int")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = texts.select(spread.alias("batch"), "doc_id", "text").repartition(batches, "batch")
    binary = pa.binary()

    def ask(rows):
        """One batch at a time; rows come sorted by it."""
        fields = pa.schema([("part", pa.int32()), ("rank", pa.int32()), ("batch", pa.int32()), *((c, binary) for c in ("keys", "groups", "tags", "counts"))])

        def requests(b, texts):
            out = [(part, rank, b, *rest) for part, rank, *rest in Batch(texts).asked(bits)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        at, held = None, []
        for r in rows:
            for b, t in zip(r.column(0).to_pylist(), r.column(2).to_pylist(), strict=True):
                if b != at and held:
                    yield requests(at, held)
                    held = []
                at = b
                held.append(t)
        if held:
            yield requests(at, held)

    def answer(rows):
        group, held = None, []

        def settle():
            made = totals(group[1], held)
            ints = [[b for b, *_ in held], [group[1]] * len(held), [group[0]] * len(held)]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in ints), *(pa.array([m[i] for m in made], binary) for i in (0, 1))], names=["batch", "rank", "part", "totals", "more"])

        for r in rows:
            for p, k, b, *rest in zip(*(r.column(i).to_pylist() for i in range(7)), strict=True):
                if (p, k) != group and held:
                    yield settle()
                    held = []
                group = (p, k)
                held.append((b, *rest))
        if held:
            yield settle()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left.column("text").to_pylist())
        parts, ranks = right.column("part").to_pylist(), right.column("rank").to_pylist()
        order = sorted(range(right.num_rows), key=parts.__getitem__)

        def of(rank: int, column: str) -> np.ndarray:
            raw = right.column(column)
            return np.concatenate([whole(raw[i].as_py(), 8) for i in order if ranks[i] == rank] or [np.zeros(0, "<u8")])

        made = list(zip(*batch.scores(of(1, "totals"), of(2, "totals"), of(2, "more")), strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([left.column("doc_id").combine_chunks(), *(pa.array(c, t) for c, t in zip(made, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    requests = dealt.sortWithinPartitions("batch").mapInArrow(ask, ASK)
    told = requests.repartition("part").sortWithinPartitions("part", "rank", "batch").mapInArrow(answer, TOLD)
    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, SCHEMA)
