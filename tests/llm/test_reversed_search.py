"""Reversed search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hybridq.llm.reversed_search import Heaps, Index, reversed_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def brute(docs, items, k):
    read = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    count, total = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in read:
            m = 100 - 75 + 75 * n * count // total
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc, score))
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["Straße", "ΔΟΚΙΜΗ", "a1", "the", "THE", "x" * 5000, "naïve", *[f"w{i}" for i in range(40)]]
    text = lambda most: rnd.choice([" ", ", ", "-\n"]).join(rnd.choices(words, k=rnd.randint(0, most)))
    docs = [(i, text(30)) for i in range(150)] + [(900, None), (901, ""), (902, " .,- "), (903, "the " * 30000), (7, text(9)), (None, "the w1 w2")]
    docs += [(1000 + i, "same words w1 w2 the") for i in range(60)]  # ties
    items = [(i, text(25)) for i in range(12)] + [(50, None), (51, "?!"), (52, "never seen"), (3, "the w1 w1"), (53, "the " * 500 + "w3"), (None, "w4")]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 1_000_000), (2, 20)])
def test_equals_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in docs], "doc_id long, text string, n int, score long, codes string").repartition(5)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    found = reversed_search(d, b, block_postings=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert reversed_search(none, items).collect() == []
    assert reversed_search(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in reversed_search(docs, items).collect()] == [(1, 1, 1)]


def test_large_sums_are_exact():
    """Scores beyond 2^53 are added in halves; document lengths beyond 64 bits as Python integers."""
    def index(times):
        return Index(np.array([4]), np.array([0, 1]), np.array([0, 0]), np.array(times), np.array([1, 1]), 10**9, 10**12)

    big = index([10**7 + 7, 10**7 + 9])
    assert big.halves and not index([1, 2]).halves
    n = np.array([3, 10**5])
    got = big.scores(n, np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2, 3, 5]))
    part = lambda tf, n: 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * 10**9 // 10**12))
    w = int(big.weight[0])
    assert got[:, 0].tolist() == [w * (part(2, 3) * (10**7 + 7) + part(3, 3) * (10**7 + 9)), w * part(5, 10**5) * (10**7 + 9)]


def test_heaps_keep_the_smallest_ids_of_ties():
    heaps = Heaps(1, 2)
    for docs in ([9, 8, 7], [1, 30], [2, 0]):
        heaps.offer(np.full((len(docs), 1), 5), np.array(docs))
    assert heaps.doc.tolist() == [0, 1]


def test_length_norm_beyond_64_bits():
    index = Index(np.array([1]), np.array([0]), np.array([0]), np.array([1]), np.array([1]), 10**12, 10**15)
    assert index.norm(np.array([10**9])).tolist() == [25 + 75 * 10**9 * 10**12 // 10**15]
