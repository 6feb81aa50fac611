"""Neighbours, web archives and the registered queries."""

import hashlib

import numpy as np
import pytest
from check_oracle import compare, connect

from hybridq.llm.bit_codes import search
from hybridq.llm.registry import ORACLE, QUERIES
from hybridq.llm.warc_fixity import archive, audit, leaves, write_warc
from hybridq.llm.workload import all_llm_queries
from hybridq.plans.stages import stage_path

all_llm_queries()


def nearest(rows, queries, k):
    """Brute force over (id, vector) rows."""
    out = {}
    for q, x in queries:
        found = {}
        for i, y in rows:
            if i != q and len(x) == len(y):
                found[i] = min(found.get(i, np.inf), float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum())))
        out[q] = sorted(((d, i) for i, d in found.items()))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    vectors[100:230] = vectors[7]  # a third are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (None, [1.0] * 16), (905, []), (906, [1.0, 2.0])]
    table = spark.createDataFrame(rows + rows[:20] + odd, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in search(table, table.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    queries = [r for r in rows if r[0] % 20 == 0]
    want = nearest(rows, queries, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.95 * 10 * len(want)
    assert [f[2] for f in sorted(got[100])] == [7, *range(101, 110)]  # ties go to the smaller id
    few = spark.createDataFrame(rows[:4] + rows[100:103], "vec_id long, embedding array<float>")
    assert search(few, few).groupBy("query_id").count().where("count <> 6").count() == 0
    assert search(few.limit(0), few.limit(0)).collect() == []


def test_archive_and_audit(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>\r\n\r\nx") for i in range(70)] + [(None, None, None), (3, "http://h/3", "again")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = archive(table, file_records=16)
    rows = sorted(records.collect(), key=lambda r: (r.file, r.piece, r.seq))
    assert len(rows) == len(pages)
    for a, b in zip(rows, rows[1:]):
        assert (b.offset == a.offset + a.length) if (a.file, a.piece) == (b.file, b.piece) else b.offset == 0
    path = stage_path(spark, "warc")
    write_warc(records, path)
    written = {f"{r.file}/{r.piece}": "" for r in rows}
    for r in rows:
        written[f"{r.file}/{r.piece}"] += r.record + "\r\n\r\n"
    files = {f.path: bytes(f.content).decode() for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect() if f.length}
    assert sorted(files.values()) == sorted(written.values())

    ours = leaves(records)
    theirs = ours.where("NOT (file = 1 AND idx = 4)").selectExpr("file", "piece", "idx", "low", "high", "IF(file = 2 AND idx IN (0, 15), 'bad', hash) AS hash")
    extra = spark.createDataFrame([(4, 0, 30, 0, 1, "more")], "file long, piece int, idx long, low long, high long, hash string")
    found, roots = audit(ours, theirs.unionByName(extra), fan=3)
    got = sorted((r.file, r.idx, r.status) for r in found.collect())
    assert got == [(1, 4, "missing"), (2, 0, "corrupt"), (2, 15, "corrupt"), (4, 30, "extra")]
    assert roots.count() == len(written) and audit(ours, ours)[0].count() == 0
    first = next(r for r in ours.collect() if r.file == 0 and r.idx == 0)
    assert first.hash == hashlib.sha256((rows[[r.page_id for r in rows].index(0)].record + "\r\n\r\n").encode()).hexdigest()
    none = archive(table.limit(0))
    assert audit(leaves(none), leaves(none))[0].collect() == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    ok, info = compare(spark, connect(sf), name, QUERIES[name], ORACLE.get(name), sf)
    assert ok in (True, None), info
