"""Operator 5 against plain Python counts."""

import math
import random
from collections import Counter

import pytest

from biblioloom.llm import lm_scoring


def grams(t):
    w = ["<s>", "<s>", *(t or "").lower().split()]
    return [(w[i - 2], w[i - 1], w[i]) for i in range(2, len(w))]


def brute(rows):
    """Every text under the counts of all the others, added up anew for each."""
    out = []
    for k, (i, t) in enumerate(rows):
        one, two, three, n = Counter(), Counter(), Counter(), 0
        for j, (_, x) in enumerate(rows):
            if j == k:
                continue
            g = grams(x)
            n += len(g)
            for u, v, w in g:
                one[w] += 1
                two[v, w] += 1
                three[u, v, w] += 1
            if g:
                one["<s>"] += 1
                two["<s>", "<s>"] += 1
        s, back, new = 0.0, 0, 0
        for u, v, w in grams(t):
            if three[u, v, w]:
                s += math.log(three[u, v, w] / two[u, v])
                continue
            back += 1
            if two[v, w]:
                s += math.log(0.4 * two[v, w] / one[v])
            else:
                new += not one[w]
                s += math.log(0.16 * (one[w] / n if one[w] else 1 / (n + 1)))
        out.append((i, len(grams(t)), back, new, round(s, 4)))
    return out


def got(df):
    return sorted(((x["doc_id"], x["n_words"], x["n_backed_off"], x["n_unseen"], round(x["log_score"], 4)) for x in df.collect()), key=repr)


@pytest.mark.parametrize("size", [200, 24 << 20])
def test_scores_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", size)
    r = random.Random(size)
    texts = [" ".join(r.choices(["a", "b", "C", "d", "é", "f" * 30], k=r.randint(0, 30))) for _ in range(25)]
    texts += [None, "", "lone", "A b", "A b c", texts[0], "new words here", " \n "]
    rows = [*enumerate(texts), (None, "a b"), (0, texts[0])]
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, batch string")
    assert got(lm_scoring.score(table)) == sorted(brute(rows), key=repr)
    assert lm_scoring.score(table.limit(0)).collect() == []


def test_very_long_texts_beside_short_ones(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 50_000)
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=2))
    rows = [(0, " ".join(word() for _ in range(60_000))), (1, "ab " * 40_000), *((i, " ".join(word() for _ in range(20))) for i in range(2, 8))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x[:4] for x in got(lm_scoring.score(table))] == [x[:4] for x in sorted(brute(rows), key=repr)]


def test_copies_are_told_from_single_texts(spark):
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(50))
    twice = text()
    table = spark.createDataFrame([(0, twice), (1, twice), *((i, text()) for i in range(2, 9))], "doc_id long, text string")
    back = {x["doc_id"]: x["n_backed_off"] for x in lm_scoring.score(table).collect()}
    assert back[0] == back[1] == 0 and all(back[i] >= 45 for i in range(2, 9))


def test_perplexity(spark):
    table = spark.createDataFrame([(1, "a a"), (2, "")], "doc_id long, text string")
    by = {x["doc_id"]: x["perplexity"] for x in lm_scoring.score(table).collect()}
    assert by[2] is None and by[1] == pytest.approx(1 / 0.16, abs=1e-5)  # nothing else to score by: each word 0.16 * 1 / (0 + 1)
