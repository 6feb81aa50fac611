"""The gated vector scan: a listing's filters are compared once for all its chunks, only allowed pairs are scored."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from hybridq.plans import blockscan as B
from hybridq.plans.blockscan import Best, CosineTopK
from hybridq.plans.matching import Filters


class Counted(Filters):
    seen = 0

    def levels(self, q, x):
        self.seen += len(x)
        return super().levels(q, x)


def sides(rng, n_queries=30, n_items=400, chunks=5, dims=64):
    def vectors(n):
        idx = [sorted(rng.choice(dims, 6, replace=False).tolist()) for _ in range(n)]
        return pa.array(idx, pa.list_(pa.int32())), pa.array([rng.normal(size=6).tolist() for _ in idx])

    pay = lambda n: pa.array([None if rng.random() < 0.2 else float(v) for v in rng.integers(1, 9, n)])
    empty = lambda n, kind: pa.nulls(n, kind)
    qi, qv = vectors(n_queries)
    q = pa.table({
        "query_id": pa.array(range(n_queries)), "idx": qi, "val": qv, "salary_min": pay(n_queries),
        **{n: empty(n_queries, pa.float64()) for n in ("salary_max", "experience_min", "experience_max", "remote")},
        "employment_type": empty(n_queries, pa.string()), "place": empty(n_queries, pa.string()),
        "level": pa.array([float(v) for v in rng.integers(0, 2, n_queries)]),
    })
    xi, xv = vectors(n_items)
    own = pa.array(np.arange(n_items) // chunks)
    facts = {"salary_min": empty(n_items, pa.float64()), "salary_max": pay(n_items // chunks).take(own)}
    x = pa.table({
        "document_id": pa.array([f"c{i}" for i in range(n_items)]), "idx": xi, "val": xv, **facts,
        **{n: empty(n_items, pa.float64()) for n in ("experience_min", "experience_max", "remote")},
        "employment_type": empty(n_items, pa.string()), "asked": empty(n_items, pa.list_(pa.string())), "item_no": own,
    })
    return q, x


def test_gated_scan_equals_all_pairs_and_looks_at_each_listing_once():
    q, x = sides(np.random.default_rng(5))
    gate = Counted()
    task = CosineTopK(7, 64, gate=gate)
    state = task.prepare(q)
    for low in range(0, len(x), 100):
        task.fold(state, x.slice(low, 100))
    got = {}
    for batch in task.finish(state):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((-np.floor(r["score"] * 1e9 + 0.5), r["document_id"]))
    assert gate.seen == len(x) // 5

    def dense(t):
        out = np.zeros((len(t), 64))
        for i, (at, v) in enumerate(zip(t["idx"].to_pylist(), t["val"].to_pylist())):
            out[i, at] = v
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    keys, allowed = -np.floor(dense(q) @ dense(x).T * 1e9 + 0.5), Filters().allowed(Filters().prepare(q), x)
    ids = x["document_id"].to_pylist()
    for i in range(len(q)):
        want = sorted((k, ids[j]) for j, k in enumerate(keys[i]) if allowed[i, j])[:7]
        assert sorted(got.get(i, [])) == want


def test_offers_of_pairs_keep_the_best():
    rng = np.random.default_rng(3)
    best, ids = Best(20, 4), np.array([f"i{j:05}" for j in range(9000)])
    scores = np.round(rng.random((20, 9000)), 2)
    for low in range(0, 9000, 1500):
        rows, cols = np.nonzero(np.ones((20, 1500), dtype=bool))
        best.offer_pairs(rows, scores[:, low : low + 1500][rows, cols], ids[low : low + 1500], cols)
    best.settle()
    for i in range(20):
        want = sorted(zip(-scores[i], ids))[:4]
        assert sorted(zip(-best.score[best.row == i], best.id[best.row == i])) == want


def test_few_items_of_a_value_stay_in_one_slot(spark, monkeypatch):
    """under match_on a query is copied to as many slots as its value has work for, and gives out k rows in each."""
    q = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3) for i in range(300)], "query_id long, embedding array<double>, g int")
    x = q.withColumnRenamed("query_id", "item")
    scan = lambda: B.block_scan(q, x, B.CosineTopK(3, 2, "query_id", "item", B.SameGroup("g")), "query_id long, item long, score double", "query_id", "item", "g")
    assert scan().count() == 300 * 3
    monkeypatch.setattr(B, "SLOT_ITEMS", 20)  # now a value's items are cut, by its share of the pairs
    assert 300 * 3 < scan().count() <= 300 * 3 * 4
    some = scan().join(q.select("query_id", "g"), "query_id").join(x.select("item", F.col("g").alias("h")), "item")
    assert some.where("g <> h").count() == 0
    alone = q.where("g = 1")  # values that nobody asks for, and values without items
    assert B.block_scan(alone, x.where("g <> 1"), B.CosineTopK(3, 2, "query_id", "item", B.SameGroup("g")), "query_id long, item long, score double", "query_id", "item", "g").count() == 0


def test_keywords_are_counted_in_the_scan():
    """F8: share of asked words among a chunk's, damped by length, of allowed pairs only, against a plain loop."""
    from hybridq.plans.matching import KeywordTopK

    rng = np.random.default_rng(6)
    say = lambda n, most: [sorted({f"w{i}" for i in rng.integers(0, 30, rng.integers(1, most))}) for _ in range(n)]
    asked, said = say(20, 6), say(1500, 25)
    lengths = [len(s) + int(rng.integers(0, 80)) for s in said]

    class Odd:
        def prepare(self, q):
            return len(q)

        def allowed_pairs(self, n, x):
            numbers = np.asarray(x.column("number").combine_chunks())
            return np.nonzero((np.arange(n)[:, None] + numbers[None, :]) % 3 == 0)

    task = KeywordTopK(7, Odd())
    state = task.prepare(pa.table({"query_id": range(20), "terms": asked}))
    x = pa.table({"document_id": [f"d{i:04}" for i in range(1500)], "number": range(1500), "n_tokens": lengths, "terms": said})
    for low in range(0, 1500, 400):
        task.fold(state, x.slice(low, 400))
    got = sorted((r["query_id"], -round(r["score"], 9), r["document_id"]) for b in task.finish(state) for r in b.to_pylist())
    want = []
    for i, a in enumerate(asked):
        scored = [(i, -round(len(set(a) & set(s)) / len(a) / (1 + np.log1p(n / 50)), 9), f"d{j:04}") for j, (s, n) in enumerate(zip(said, lengths)) if (i + j) % 3 == 0 and set(a) & set(s)]
        want += sorted(scored)[:7]
    assert got == sorted(want)
