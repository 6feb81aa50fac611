"""The pipeline's stages, each against a brute-force version on its own input."""

import re

import corpus_pipeline as P
import pytest
from test_jaccard_join import brute as components, shingles
from test_suffix_dedup import brute as repeats

from hybridq.plans.stages import materialise


@pytest.fixture(scope="module")
def stages(spark, sf):
    """[(docs before, docs after), ...] as lists of rows by doc_id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, before = [], {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in P.STAGES:
        made = materialise(stage(spark, docs, sf), name)
        rows = made.collect()
        if name != "packing":
            assert made.columns == columns
            assert len({r.doc_id for r in rows}) == len(rows)
        after = rows if name == "packing" else {r.doc_id: r for r in rows}
        out.append((before, after))
        docs, before = made, after
    return out


def test_quality_keeps_whole_rows(stages):
    before, after = stages[0]
    assert 0 < len(after) <= len(before)
    assert all(before[i] == r for i, r in after.items())


def test_exact_copies(stages):
    before, after = stages[1]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
    assert after == {i: before[i] for i in first.values()}


def test_near_copies(stages):
    before, after = stages[2]
    ids = sorted(before)
    found = components([shingles(before[i].text) for i in ids])
    assert after == {ids[c]: before[ids[c]] for c in set(found)}


def test_repeated_strings(stages):
    before, after = stages[3]
    ids = sorted(before)
    want = [w[3].decode("utf-8", "ignore") for w in repeats([before[i].text for i in ids], P.REPEAT_BYTES)]
    assert [after[i].text for i in ids] == want
    assert all(r.n_chars == len(r.text) and r.lang == before[i].lang for i, r in after.items())


def test_packing_covers_every_document(stages):
    before, pieces = stages[4]
    spans = {}
    for p in pieces:
        spans.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert set(spans) == set(before)
    for s in spans.values():
        s.sort()
        assert [a for a, _, _ in s] == [sum(n for _, n, _ in s[:k]) for k in range(len(s))]
        assert sum(n for _, n, _ in s) == s[0][2]
