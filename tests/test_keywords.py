"""The keyword index against a plain ranking; places and the filter grid against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hybridq.operators import filters as X
from hybridq.operators import keywords as K
from hybridq.workload.tables import listings, query_log


def ranking(queries, chunks, k, may=lambda q, d: True):
    out = []
    for q, text in queries:
        asked = list(dict.fromkeys(text.split()))
        scored = []
        for d, body in chunks:
            held = body.split()
            hits = len(set(asked) & set(held))
            if hits and may(q, d):
                score = hits / len(asked) / (1 + math.log1p(len(held) / 50))
                scored.append((-math.floor(score * 1e9 + 0.5), d, round(score, 9)))
        out += [(q, d, s, rank) for rank, (_, d, s) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed):
    """Words that nothing maps or stems; one of them stands in nearly every chunk."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    body = lambda: " ".join((["w0"] if rnd.random() < 0.9 else []) + [words[min(59, int(rnd.expovariate(0.08)))] for _ in range(rnd.randint(1, 120))])
    chunks = [(f"d{i:03}", body()) for i in range(400)] + [("empty", ""), *[(f"t{i}", "w1 w2") for i in range(9)]]
    queries = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 14)))) for i in range(25)] + [(90, ""), (91, "unheard"), (92, "w0"), (93, "w0 w0 w59 unheard")]
    return queries, chunks


@pytest.mark.parametrize("seed,block,k", [(1, 8, 5), (2, 128, 20), (3, 4, 500)])
def test_keyword_index_equals_ranking(spark, seed, block, k):
    queries, chunks = corpus(seed)
    q = spark.createDataFrame(queries, "query_id long, text string")
    x = spark.createDataFrame(chunks, "document_id string, text string").repartition(3)
    index = K.keyword_index(x, block=block)
    got = sorted((r.query_id, r.document_id, round(r.score, 9), r.rank) for r in K.search_keywords(q, index, k).collect())
    assert got == ranking(queries, chunks, k)
    # a filter on pairs holds in every step
    keep = lambda pairs: pairs.where(F.pmod(F.crc32(F.col("document_id").cast("binary")), F.lit(3)) == F.pmod("query_id", F.lit(3)))
    import zlib

    some = K.search_keywords(q, index, k, keep).collect()
    assert sorted((r.query_id, r.document_id, round(r.score, 9), r.rank) for r in some) == ranking(
        queries, chunks, k, lambda a, d: zlib.crc32(d.encode()) % 3 == a % 3
    )


def test_blocks_are_left_out(spark):
    queries, chunks = corpus(5)
    index = K.keyword_index(spark.createDataFrame(chunks, "document_id string, text string"), block=8)
    work = K.search_work(spark.createDataFrame(queries, "query_id long, text string"), index, 5).agg(F.sum("blocks"), F.sum("blocks_read")).first()
    assert 0 < work[1] < 0.8 * work[0]


def test_empty_index_and_no_results(spark):
    none = spark.createDataFrame([], "document_id string, text string")
    q = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert K.search_keywords(q, K.keyword_index(none), 3).collect() == []
    some = K.keyword_index(spark.createDataFrame([("a", "w1")], "document_id string, text string"))
    assert K.search_keywords(q, some, 0).collect() == []


def test_places_with_a_common_beginning(spark):
    """Nine of ten names begin alike, in any case; asked are beginnings, ends, single letters, nothing and null."""
    rnd = random.Random(4)
    names = [("San " if i % 10 else "") + "".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) + rnd.choice(["", ", North", ", SOUTH"]) for i in range(300)]
    asked = ["san", "San ", "north", "th", "a", "é", "", "SAN A", "nowhere", names[5], names[5].upper(), names[7][2:]]
    found = X.match_places(
        spark.createDataFrame([(a,) for a in [*asked, None, "san"]], "asked string"), spark.createDataFrame([(n,) for n in [*names, None]], "place string")
    ).collect()
    want = {(a, n) for a in asked for n in names if a.lower() in n.lower()}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_the_grid_tests_few_pairs(spark, sf):
    q, rows = query_log(spark, "/root/testdata/sf0.01"), listings(spark, "/root/testdata/sf0.01")
    tested, kept = X.filter_candidates(q, rows, verify=False).count(), X.filter_candidates(q, rows).count()
    assert 0 < kept <= tested < 3 * kept


def test_the_grid_with_odd_ranges(spark):
    """Unknown ends, ranges turned round, wide ranges and bounds beyond all listings."""
    rnd = random.Random(9)
    pick = lambda *values: rnd.choice([None, *values])
    facts = [
        (i, pick("Pune, India", "Goa", "*"), pick(True, False), pick("FULL_TIME", "CONTRACT"), pick(0, 2, 9, 70), pick(1, 3, 8, 40, 90),
         pick(0, 300000, 900000), pick(400000, 2000000, 10**12)) for i in range(250)
    ]
    names = "id long, location string, remote boolean, employment_type string, experience_min int, experience_max int, salary_min long, salary_max long"
    asked = [
        (i, (pick("pune", "a", "goa", "*"), pick(True, False), pick("FULL_TIME"), pick(0, 2, 7, 80), pick(1, 5, 60), pick(0, 350000, 10**13), pick(100, 950000)))
        for i in range(60)
    ]
    criteria = "location string, remote boolean, employment_type string, experience_min int, experience_max int, salary_min long, salary_max long"
    q = spark.createDataFrame(asked, f"query_id long, criteria struct<{criteria.replace(' ', ':').replace(',:', ',')}>")
    rows = spark.createDataFrame(facts, names)
    got = sorted(tuple(r) for r in X.filter_candidates(q, rows).collect())
    every = q.crossJoin(rows).where(X.passes_all(F.col("criteria"))).select("query_id", "id")
    assert got == sorted(tuple(r) for r in every.collect()) and len(got) > 100


def test_both_ways_of_a_scan_agree(spark):
    """Blocks of queries sent to the items, several of them, and items shuffled to blocks of queries."""
    from hybridq.plans.blockscan import CosineTopK, block_scan

    rnd = random.Random(2)
    vector = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    q = spark.createDataFrame([(i, vector()) for i in range(70)], "query_id long, embedding array<double>")
    x = spark.createDataFrame([(i, vector()) for i in range(500)], "document_id long, embedding array<double>").repartition(5)
    ways = []
    for block, sent in ((2048, 8), (20, 8), (20, 0)):
        hits = block_scan(q, x, CosineTopK(3, 8), "query_id long, document_id long, score double", query_block=block, sent_blocks=sent)
        best = {}
        for r in hits.collect():
            best.setdefault(r.query_id, []).append((-round(r.score, 9), r.document_id))
        ways.append({k: sorted(v)[:3] for k, v in best.items()})
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 70
    none = block_scan(q.where("false"), x, CosineTopK(3, 8), "query_id long, document_id long, score double")
    assert none.collect() == []
    plan = block_scan(q, x.select("*"), CosineTopK(3, 8), "query_id long, document_id long, score double")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition of the test's own table
