"""Quality scores equal a plain forward pass that walks over windows and chunks, one document at a time."""

import numpy as np
from pyspark.sql import functions as F

from hybridq.llm import byte_cnn as net
from hybridq.llm.quality import good_documents, score_documents


def plain_score(m: net.Model, text: str | None) -> float:
    data = (text or "").encode()
    blocks = max(2, -(-len(data) // net.BLOCK_BYTES))
    codes = [*data] + [net.PAD] * (blocks * net.BLOCK_BYTES + net.WIDTH - len(data))
    filters = np.concatenate([m.near, m.far]).astype(np.float64)
    embed = m.embed.astype(np.float64)
    answers = []
    for at in range(0, blocks * net.BLOCK_BYTES, net.STRIDE):
        window = np.concatenate([embed[c] for c in codes[at : at + net.WIDTH]])
        answers.append(np.maximum(window @ filters + m.bias, 0))
    peak = np.zeros(net.HIDDEN)
    for first in range(blocks - 1):
        chunk = np.array(answers[first * net.BLOCK : (first + 2) * net.BLOCK])
        features = np.concatenate([chunk.max(axis=0), chunk.mean(axis=0)])
        peak = np.maximum(peak, features @ m.hidden + m.hidden_bias)
    return 1 / (1 + np.exp(-(peak @ m.out + m.out_bias[0])))


def test_scores_equal_a_plain_pass(spark, sf):
    m = net.train([b"good prose, told well. " * 20, b"", b"$$$ BUY NOW !!! " * 30, b"a quiet day"], [1, 1, 0, 1], epochs=3)
    edge = [None, "", "x", "é" * 64, "y" * net.BLOCK_BYTES, "z" * (2 * net.BLOCK_BYTES + 1), "w" * 300_000, "A long word. " * 20_000]
    extra = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(edge + edge[:4])], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("clash"))
    rows = docs.collect()
    want = {r.doc_id: plain_score(m, r.text) for r in rows}
    got = {r.doc_id: r.score for r in score_documents(docs, m).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4
    # a threshold in the widest gap of the middle scores, so that rounding decides nothing
    middle = sorted(want.values())[len(want) // 4 : -(len(want) // 4)]
    gap = int(np.argmax(np.diff(middle)))
    threshold = (middle[gap] + middle[gap + 1]) / 2
    kept = good_documents(docs, m, threshold).collect()
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in rows if want[r.doc_id] >= threshold)
