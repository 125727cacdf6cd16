"""Operator 7, quality rules: a linear-chain CRF labels the lines of a text.

Every line with a word is one position of a chain; its two labels are *content* and
*boilerplate*. Emission features come from the line alone (symbols, pipes, capitals, digits,
shouting, repetition, length), transitions tie neighbouring lines, and Viterbi decoding picks
the best joint labelling. The share of word bytes in content lines decides whether a text stays.

The chain is trained on a bounded sample of labelled texts (``TRAIN_DOCS``). Labels say only whether
a text as a whole is good, so its lines get weak labels of their own (``weak_lines``): a line of a
bad text is boilerplate if it shows any mark of it, a line of a good text only if it shows many, and a
bad text without any mark is boilerplate throughout. So chains change their label within a text,
and what the transitions learn is where content begins and ends. Without usable labels the fixed
``PRIOR`` weights are used.

Defined results: null or empty text: no words, base_failed, not kept. Rows repeat as they
repeat in the input; a null doc_id stays null. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import sample_ids, small_batches

#: Bounds of the training sample: labelled texts, and characters of one of them.
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
#: A text is kept if at least this share of its word bytes lies in content lines.
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS, UPPER, LOWER, DIGITS, SHOUTS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!?"

#: Features are one-hot buckets; each has a row (boilerplate, content) of weights.
EDGES = {
    "symbols": (0.001, 0.02, 0.06, 0.15),
    "pipes": (0.001, 0.1, 0.4),
    "capitals": (0.1, 0.3, 0.6),
    "digits": (0.02, 0.2, 0.5),
    "shouts": (0.01, 0.05, 0.1),
    "repeats": (0.05, 0.3, 0.6),
    "words": (2, 5, 12, 40),
}
OFFSETS = dict(zip(EDGES, np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])[:-1].tolist(), strict=True))
N_FEATURES = sum(len(e) + 1 for e in EDGES.values()) + 2
SEEN, CLOSED = N_FEATURES - 2, N_FEATURES - 1
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, content_share double"
)


def _bucket(name: str, value: float) -> int:
    edges, at = EDGES[name], 0
    while at < len(edges) and value >= edges[at]:
        at += 1
    return OFFSETS[name] + at


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    """Indices of the features that hold for one line."""
    n = max(1, sum(map(len, words)))
    upper = len(line) - len(line.translate(None, UPPER))
    lower = len(line) - len(line.translate(None, LOWER))
    found = [
        _bucket("symbols", (len(line) - len(line.translate(None, SYMBOLS))) / n),
        _bucket("pipes", line.count(b"|") / len(words)),
        _bucket("capitals", upper / max(1, upper + lower)),
        _bucket("digits", (len(line) - len(line.translate(None, DIGITS))) / n),
        _bucket("shouts", (len(line) - len(line.translate(None, SHOUTS))) / n),
        _bucket("repeats", _repeated_pairs(words)),
        _bucket("words", len(words)),
    ]
    if seen:
        found.append(SEEN)
    if line.rstrip(SPACE)[-1:] in (b".", b"?", b"!", b":"):
        found.append(CLOSED)
    return found


def _repeated_pairs(words: list[bytes]) -> float:
    if len(words) < 6:
        return 0.0
    return 1 - len(set(zip(words, words[2:], strict=False))) / (len(words) - 2)


def prior() -> dict:
    """Weights without training: every bucket above the first speaks for boilerplate."""
    emit = np.zeros((N_FEATURES, 2))
    for name, edges in EDGES.items():
        if name != "words":
            for at in range(len(edges) + 1):
                emit[OFFSETS[name] + at, 0] = -1.0 if at == 0 else 1.5 * at
    emit[SEEN, 0] = 1.0
    return {"emit": emit, "step": np.array([[1.0, -1.0], [-1.0, 1.0]]), "start": np.zeros(2)}


PRIOR = prior()


def chain_of(text: bytes) -> list[list[int]]:
    seen, chain = set(), []
    for line in text.split(b"\n"):
        if words := line.split():
            chain.append(line_features(line, words, line in seen))
            seen.add(line)
    return chain


#: Marks (bucket levels of all features but length, and a repeat) from which a line of a bad or a good text is boilerplate.
MARKS = {0: 1, 1: 4}


def marks(found: list[int]) -> int:
    """How many bucket levels above the plain ones a line shows, and one if it repeats an earlier line."""
    level = sum(f - OFFSETS[n] for n, e in EDGES.items() if n != "words" for f in found if OFFSETS[n] <= f <= OFFSETS[n] + len(e))
    return level + (SEEN in found)


def weak_lines(chain: list[list[int]], good: int) -> list[int]:
    """A label (1: content) for each line of a text of which only the quality is known."""
    lines = [int(marks(found) < MARKS[good]) for found in chain]
    return [0] * len(chain) if not good and all(lines) else lines


def train(chains: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.1, shrink: float = 1e-4) -> dict:
    """Maximum-likelihood weights by Adam; ``chains`` are (features by line, labels by line)."""
    chains = sorted((c for c in chains if c[0]), key=lambda c: -len(c[0]))
    if len({label for _, lines in chains for label in lines}) < 2:
        return PRIOR
    lengths = np.array([len(c) for c, _ in chains])
    width, depth = len(chains), int(lengths[0])
    x, want = np.zeros((depth, width, N_FEATURES), np.float32), np.zeros((depth, width, 2))
    for j, (chain, lines) in enumerate(chains):
        for t, (found, label) in enumerate(zip(chain, lines, strict=True)):
            x[t, j, found] = 1
            want[t, j, label] = 1
    # texts that are mostly content and the others weigh the same, however the sample is mixed
    gold = np.array([sum(lines) * 2 > len(lines) for _, lines in chains])
    live = [int((lengths > t).sum()) for t in range(depth)]
    weight = np.where(gold == 1, 0.5 / max(1, (gold == 1).sum()), 0.5 / max(1, (gold == 0).sum())) / lengths.mean()
    parts = {"emit": np.zeros((N_FEATURES, 2)), "step": np.zeros((2, 2)), "start": np.zeros(2)}
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    for turn in range(1, rounds + 1):
        scores = x @ parts["emit"].astype(np.float32)
        alpha = np.zeros((depth, width, 2))
        alpha[0] = scores[0] + parts["start"]
        for t in range(1, depth):
            n = live[t]
            alpha[t, :n] = scores[t, :n] + np.logaddexp.reduce(alpha[t - 1, :n, :, None] + parts["step"], axis=1)
        beta = np.zeros((depth, width, 2))
        for t in range(depth - 2, -1, -1):
            n = live[t + 1]
            beta[t, :n] = np.logaddexp.reduce(parts["step"] + (scores[t + 1, :n] + beta[t + 1, :n])[:, None, :], axis=2)
        total = np.logaddexp.reduce(alpha[0] + beta[0], axis=1)
        grad = {k: -shrink * v for k, v in parts.items()}
        for t in range(depth):
            n = live[t]
            miss = (want[t, :n] - np.exp(alpha[t, :n] + beta[t, :n] - total[:n, None])) * weight[:n, None]
            grad["emit"] = grad["emit"] + x[t, :n].T @ miss
            if t == 0:
                grad["start"] = grad["start"] + miss.sum(0)
            else:
                pair = np.exp(
                    alpha[t - 1, :n, :, None] + parts["step"] + (scores[t, :n] + beta[t, :n])[:, None, :] - total[:n, None, None]
                )
                true = want[t - 1, :n, :, None] * want[t, :n, None, :]
                grad["step"] = grad["step"] + ((true - pair) * weight[:n, None, None]).sum(0)
        for k in parts:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            parts[k] = parts[k] + rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return parts


def viterbi(chain: list[list[int]], model: dict) -> list[int]:
    """The best labels (1: content) of a chain of feature lists."""
    emit, step, start = model["emit"].tolist(), model["step"].tolist(), model["start"].tolist()
    return _decode(chain, emit, step, start)


def _decode(chain, emit, step, start) -> list[int]:
    if not chain:
        return []
    back = []
    b, c = start
    for t, found in enumerate(chain):
        eb = ec = 0.0
        for f in found:
            row = emit[f]
            eb += row[0]
            ec += row[1]
        if t == 0:
            b, c = b + eb, c + ec
            continue
        bb, cb, bc, cc = b + step[0][0], c + step[1][0], b + step[0][1], c + step[1][1]
        back.append((0 if bb > cb else 1, 0 if bc > cc else 1))
        b, c = max(bb, cb) + eb, max(bc, cc) + ec
    at = 1 if c >= b else 0
    labels = [at]
    for came in reversed(back):
        at = came[at]
        labels.append(at)
    return labels[::-1]


def count_repeats(words: list[bytes], span: int = 5) -> int:
    """Words inside windows of ``span`` words that occur twice or more, first occurrence included."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(span)), strict=False))
    if len(set(windows)) == n:
        return 0
    often = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + span - max(i, end)
            end = i + span
    return total


def judge(text: str | None, emit, step, start) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, chain, sizes, repeated = set(), [], [], 0
    for line in raw.split(b"\n"):
        if own := line.split():
            again = line in seen
            repeated += again
            seen.add(line)
            chain.append(line_features(line, own, again))
            sizes.append(sum(map(len, own)))
    labels = _decode(chain, emit, step, start)
    content = sum(s for s, y in zip(sizes, labels, strict=True) if y)
    share = content / sum(sizes) if sizes else 0.0
    repeats = count_repeats(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    return (
        len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), repeated, repeats,
        failed, not failed and share >= MIN_CONTENT, len(chain), sum(labels), share,
    )


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """Train on at most TRAIN_DOCS labelled texts of at most TRAIN_CHARS characters."""
    known = {r[0]: r[1] for r in sample_ids(labels.where(F.col("quality").isNotNull()), "doc_id", ["quality"], TRAIN_DOCS)}
    if not known:
        return PRIOR
    rows = (
        documents.where(F.col("doc_id").isin(list(known)) & (F.char_length("text") <= TRAIN_CHARS))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    chains = [(chain_of(r["text"].encode("utf-8", "surrogatepass")), int(known[r["doc_id"]] > 0)) for r in rows]
    return train([(chain, weak_lines(chain, good)) for chain, good in chains])


def assess(documents: DataFrame, model: dict) -> DataFrame:
    """Counts, base verdict and the chain's verdict for every row of ``documents``."""
    small_batches(documents.sparkSession)
    emit, step, start = model["emit"].tolist(), model["step"].tolist(), model["start"].tolist()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def work(batches):
        for batch in batches:
            made = [judge(t, emit, step, start) for t in batch.column(1).to_pylist()]
            columns = list(zip(*made, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)


def filter_documents(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of ``documents`` that the chain keeps, with all their columns, without a shuffle."""
    small_batches(documents.sparkSession)
    emit, step, start = model["emit"].tolist(), model["step"].tolist(), model["start"].tolist()
    at = documents.columns.index("text")

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array([judge(t, emit, step, start)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(work, documents.schema)
