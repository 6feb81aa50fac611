"""Induced sorting, common prefixes and the removal of repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from hybridq.llm.suffix_array import permuted_prefixes, suffix_array
from hybridq.llm.suffix_dedup import suffix_dedup


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, rng.integers(2, 6), rng.integers(1, 300))
    s = np.append(np.tile(s, 3) if seed % 3 == 0 else np.ones_like(s) if seed % 7 == 0 else s, 0)
    text = s.tolist()
    sa = suffix_array(s, int(s.max()) + 1)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    common, phi = permuted_prefixes(s, sa)
    for a, b in zip(sa[1:], sa):
        n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
        assert phi[a] == b and common[a] == n


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, kept))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(14)) for _ in range(4)]
    texts = [None, "", "short", "x" * 130, "ab" * 70, "é" * 40]
    for _ in range(60):
        parts = [word() for _ in range(rnd.randint(0, 25))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(passages))
        texts.append(" ".join(parts))
    near = texts[10]
    texts += [texts[20]] * 5 + [near, near.replace("a", "b", 1), near + " tail", "head " + near]
    texts += [f"{rnd.random()} {passages[0]} {rnd.random()}" for _ in range(30)]
    return texts


@pytest.mark.parametrize("hot_bytes", [1 << 20, 200])
def test_removal_equals_brute_force(spark, hot_bytes):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, hits int")
    found = suffix_dedup(docs, window=24, hot_bytes=hot_bytes, shard_bytes=2000).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
    assert len(found) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(texts, 24)
    assert found[0].kept_in == "x"


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(empty, window=24).collect() == []
    # repeated rows and null ids are rows of their own
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(50))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text[:30]), (2, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(rows, window=24).collect())
    assert got == [(0, 30), (1, 50), (1, 50), (2, 0)]
