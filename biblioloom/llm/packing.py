"""Operator 10, packing: cost-balanced sequences of at most ``CAPACITY`` tokens.

A text becomes its token ids and a closing id 0. Whole multiples of the capacity are sequences
by themselves. The rests of a block are dealt in descending order of length to the sequence of
lowest cost (linear plus quadratic attention cost, summed over its pieces) that still has room;
a rest that fits nowhere is cut to fill the sequence with most room. The rooms add up to the
block's tokens (the last ones are powers of two), so no padding is needed.

A block is a part of one input partition with at most ``BLOCK_TOKENS`` tokens in rests, so the
work needs neither a shuffle nor memory that grows with the input, and a lost task is repeated
alike. ``sequence_id`` holds the partition in its upper bits.

Defined results: null text counts as empty (the closing id alone); repeated rows are packed
each; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import small_batches

CAPACITY = 1024
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Tokens in rests that one block gathers before it is packed.
BLOCK_TOKENS = 6_000_000
#: Words whose ids a worker remembers: up to twice as many, the ones of late use first.
KNOWN_WORDS = 800_000
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
END = np.zeros(1, "<u4").tobytes()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, remembering words.

    Before a single space that a non-space follows, a byte-level BPE always starts a new piece,
    so the ids of a text are those of its words with their leading space. Texts with other
    runs of white space after a space are encoded whole. New words of a text are encoded
    together: each of them starts at the only kind of token that begins with a space.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd = re.compile(r" (?:\s|$)").search
        self.marks = {m: self.encode(m) for m in ",."}
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def learn(self, words: list[str]) -> None:
        """Makes ``words`` known; a closing mark after a Latin letter is a piece of its own."""
        old, young, bases, closed = self.old, self.young, {}, []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            elif w[-1:] in self.marks and "A" <= w[-2:-1] < "\u0250" and w[-2].isalpha():
                closed.append(w)
                base = w[:-1]
                if base not in young:
                    if (ids := old.get(base)) is not None:
                        young[base] = ids
                    else:
                        bases[base] = None
            else:
                bases[w] = None
        if bases:
            ids = self.ids(" " + " ".join(bases))
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(bases):
                raw, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                young.update(zip(bases, [raw[s:e] for s, e in zip((4 * cuts).tolist(), ends, strict=True)], strict=True))
            else:  # a special token's own text may take the space with it
                young.update({w: self.encode(f" {w}") for w in bases})
        for w in closed:
            young[w] = young[w[:-1]] + self.marks[w[-1]]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        if len(self.young) > KNOWN_WORDS:
            self.old, self.young = self.young, {}
        if missing := set(rest).difference(self.young):
            self.learn(list(missing))
        return b"".join([self.encode(first), *map(self.young.__getitem__, rest)])


def rooms(tokens: int) -> np.ndarray:
    """Capacities that add up to ``tokens``: full ones, then the powers of two of what is left."""
    left = tokens % CAPACITY
    return np.array([CAPACITY] * (tokens // CAPACITY) + [1 << b for b in range(9, -1, -1) if left >> b & 1], np.int64)


def deal(lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each piece, in the order given, its cuts: (room, offset, length). All rooms end up full."""
    total = sum(lengths)
    size = rooms(total)
    # stacks of rooms by what they have left, lowest cost on top
    import heapq

    heaps: list[list[tuple[float, int]]] = [[] for _ in range(CAPACITY + 1)]
    for i, s in enumerate(size.tolist()):
        heaps[s].append((0.0, i))
    best = np.full(CAPACITY + 1, np.inf)
    for s, h in enumerate(heaps):
        if h:
            heapq.heapify(h)
            best[s] = h[0][0]
    used = [0] * len(size)
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    for j in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        left = lengths[j]
        while left:
            s = left + int(best[left:].argmin())
            if best[s] == np.inf:  # no room for all of it: cut it at the largest
                s = int(np.flatnonzero(best != np.inf)[-1])
            take = min(left, s)
            cost, i = heapq.heappop(heaps[s])
            best[s] = heaps[s][0][0] if heaps[s] else np.inf
            out[j].append((i, used[i], take))
            used[i] += take
            if s > take:
                heapq.heappush(heaps[s - take], (cost + LINEAR * take + QUADRATIC * take * take, i))
                best[s - take] = heaps[s - take][0][0]
            left -= take
    return out


class Block:
    """Gathers the pieces of one partition; sequence numbers go on from block to block."""

    def __init__(self, partition: int):
        self.next = partition << 32
        self.rows: list[tuple] = []
        self.rests: list[tuple] = []
        self.tokens = 0

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        full = n - n % CAPACITY
        for at in range(0, full, CAPACITY):
            self.rows.append((doc, at, CAPACITY, zlib.crc32(ids[4 * at : 4 * (at + CAPACITY)]), n, self.next, 0))
            self.next += 1
        if n > full:
            self.rests.append((doc, full, n, ids[4 * full :]))
            self.tokens += n - full

    def pack(self) -> None:
        dealt = deal([n - start for _, start, n, _ in self.rests])
        for (doc, start, n, ids), cuts in zip(self.rests, dealt, strict=True):
            at = 0
            for room, offset, length in cuts:
                piece = ids[4 * at : 4 * (at + length)]
                self.rows.append((doc, start + at, length, zlib.crc32(piece), n, self.next + room, offset))
                at += length
        self.next += len(rooms(self.tokens))
        self.rests, self.tokens = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(documents: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of every row of ``documents``; ``tokenizer`` is the path of its file."""
    small_batches(documents.sparkSession)

    def work(batches):
        encode, block = Encoder(tokenizer), Block(TaskContext.get().partitionId())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc, encode(text or "") + END)
                if block.tokens >= BLOCK_TOKENS:
                    block.pack()
            if len(block.rows) >= 20_000:
                yield block.batch()
        block.pack()
        yield block.batch()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
