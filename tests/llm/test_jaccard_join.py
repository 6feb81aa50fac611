"""Prefix-tree links and the whole join against brute force."""

import random
import re

import numpy as np
import pytest

from hybridq.llm.jaccard_join import jaccard_components
from hybridq.llm.prefix_tree import group_links


class Union(dict):
    def find(self, i):
        while self.setdefault(i, i) != i:
            i = self[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self[max(i, j)] = min(i, j)


def brute(sets, percent=75):
    union = Union()
    for i, a in enumerate(sets):
        union.find(i)
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                union.join(i, j)
    return [union.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(80))
def test_group_links(seed):
    r = random.Random(seed)
    base = [r.sample(range(300), r.randint(1, 40)) for _ in range(r.randint(1, 4))]
    sets = []
    for _ in range(r.randint(2, 40)):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 6)):
            s.symmetric_difference_update({r.choice(sorted(s) + [r.randint(0, 9999)])})
        if s:
            sets.append(s)
    union = Union()
    for i, j in group_links([np.array(sorted(s), dtype=np.uint64) for s in sets]):
        union.join(i, j)
    assert [union.find(i) for i in range(len(sets))] == brute(sets)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def corpus():
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + r.choice("xyzéö") + str(r.randint(0, 40))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " \n ", "One two", "one  TWO", "a b c d", "a b c d e", "A b c d e", "x"]
    for _ in range(25):
        words = [word() for _ in range(r.randint(6, 60))]
        for _ in range(r.randint(1, 9)):
            copy = list(words)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + line if r.random() < 0.4 else ""))
    return texts + texts[20:30]


@pytest.mark.parametrize("group_sets,frequent", [(4000, 1000), (3, 5)])
def test_components_equal_brute_force(spark, group_sets, frequent):
    texts = corpus()
    docs = spark.createDataFrame([(7 + i, t, i, "b") for i, t in enumerate(texts)], "doc_id long, text string, n int, bucket string")
    rows = {r.doc_id: r for r in jaccard_components(docs.repartition(3), group_sets=group_sets, frequent=frequent).collect()}
    sets = [shingles(t) for t in texts]
    assert [rows[7 + i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [rows[7 + i].component_id for i in range(len(texts))] == [7 + c for c in brute(sets)]


def test_odd_tables(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in jaccard_components(rows).collect()) == ["5", "5", "5", "None"]
