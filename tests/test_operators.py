"""Invariants and edge cases, on small invented inputs."""

import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hybridq import vocab
from hybridq.functions.chunking import hard_wrap, split_text
from hybridq.functions.formats import format_experience, format_lakhs, format_salary
from hybridq.functions.text import tokenize
from hybridq.operators import conversations as V
from hybridq.operators import filters as X
from hybridq.operators import retrieval as R
from hybridq.operators import understanding as U
from hybridq.operators.embedding import embed_hashing, index_build, to_dense
from hybridq.plans import search as P
from hybridq.plans.joins import spread_join
from hybridq.sources import listings as L
from hybridq.sources.index_store import index_read, index_write
from hybridq.streaming import streams as S
from hybridq.workload.tables import listings, query_log, view

c = F.col


# ---------------------------------------------------------------------------
# Chunking against a plain rendering of the rules
# ---------------------------------------------------------------------------
def wrap_plain(sentence, limit):
    out, line = [], ""
    for word in re.split(r"[ \t\n\x0b\f\r]+", sentence):
        if line and len(line) + len(word) + 1 > limit:
            out.append(line[:-1])
            line = ""
        line += word + " "
    if line:
        out.append(line[:-1])
    return out


def split_plain(text, limit):
    ctrl = "".join(map(chr, range(33)))
    text = text.strip(ctrl)
    if not text:
        return []
    if len(text) <= limit:
        return [text]
    out, cur, prev = [], "", None
    for raw in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", text):
        s = raw.strip(ctrl)
        if not s:
            continue
        if len(s) > limit:
            if cur:
                out.append(cur[:-1])
            out += wrap_plain(s, limit)
            cur, prev = "", None
            continue
        if cur and len(cur) + len(s) + 1 > limit:
            out.append(cur[:-1])
            cur = prev + " " if prev is not None and len(prev) + len(s) + 1 <= limit else ""
        cur += s + " "
        prev = s
    if cur:
        out.append(cur[:-1])
    return out


def test_split_text_edges(spark):
    rows = [
        ("a" * 40,), ("a" * 41,), ("one two. three! four? " * 5,), ("  \n\t ",), ("x" * 100,), ("",), (None,),
        ("first line\nsecond line\n\n" * 4,), ("no boundary here at all " * 4,), ("a. b. c. " * 20,),
    ]
    got = spark.createDataFrame(rows, "t string").select("t", split_text(c("t"), 40).alias("x")).collect()
    for r in got:
        assert r.x == split_plain(r.t or "", 40), r.t


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n é", max_size=120), min_size=1, max_size=20), st.integers(5, 60))
def test_split_text_property(spark, texts, limit):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_text(c("t"), limit).alias("x"))
    for r in got.collect():
        assert r.x == split_plain(r.t, limit)
        assert all(len(p) <= limit or " " not in p for p in r.x)


def test_hard_wrap_documents(spark, sf):
    docs = view(spark, sf, "documents").select(hard_wrap(c("text"), F.lit(200)).alias("x"), "text").collect()
    assert all(r.x == wrap_plain(r.text, 200) for r in docs)


def test_sections_and_overlap(spark, sf):
    index = index_build(listings(spark, sf))
    ids = index.groupBy("document_id").count().where("count > 1").count()
    assert ids == 0
    sections = index.groupBy("job_id").agg(F.collect_set("section").alias("s")).select(F.size("s").alias("n")).distinct()
    assert [r.n for r in sections.collect()] == [5]
    assert index.where((F.length("text") > 900) & (c("section") != "OVERVIEW")).count() == 0


# ---------------------------------------------------------------------------
# Formats, tokens, embedding
# ---------------------------------------------------------------------------
def test_formats(spark):
    row = spark.range(1).select(
        format_lakhs(F.lit(1_250_000)).alias("a"), format_lakhs(F.lit(1_000_000)).alias("b"), format_lakhs(F.lit(1_255_000)).alias("c"),
        format_salary(F.lit(1_200_000), F.lit(1_800_000), F.lit(None).cast("string")).alias("d"),
        format_salary(F.lit(1000), F.lit(2000), F.lit("USD")).alias("e"), format_experience(F.lit(1), F.lit(1)).alias("f"),
        format_experience(F.lit(2), F.lit(5)).alias("g"),
    ).first()
    assert list(row) == ["12.5", "10", "12.6", "₹12-18 LPA", "USD 1,000-2,000", "1 year", "2-5 years"]


def test_tokenize(spark):
    rows = [("C# and .NET developers, CI/CD on K8s",), ("React Native apps vs Reactjs",), ("Élan REST APIs class glass",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "x string").select(tokenize(c("x")).alias("t")).collect()]
    assert got[0] == ["csharp", "dotnet", "engineer", "cicd", "kubernete"]
    assert got[1] == ["reactnative", "apps", "vs", "react"]
    assert got[2] == ["lan", "restapi", "class", "glass"]
    assert got[3] == []


def test_embedding_norm_and_order(spark):
    rows = [(1, "remote java backend engineer"), (2, "java backend developer, remote"), (3, "pastry chef in paris"), (4, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: np.array(r.v) for r in embed_hashing(df, ["id"]).select("id", to_dense(c("idx"), c("val")).alias("v")).collect()}
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-9 for i in (1, 2, 3)) and np.linalg.norm(got[4]) == 0
    assert got[1] @ got[2] > got[1] @ got[3]
    again = {r.id: r.idx for r in embed_hashing(df.orderBy(c("id").desc()), ["id"]).collect()}
    assert again == {r.id: r.idx for r in embed_hashing(df, ["id"]).collect()}


# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------
def brute(q, x, k, allow=lambda a, b: True):
    out = {}
    for qi, qv, qg in q:
        qv = np.array(qv) / (np.linalg.norm(qv) or 1)
        scored = [
            (-np.floor(float(qv @ (np.array(v) / (np.linalg.norm(v) or 1))) * 1e9 + 0.5), xi)
            for xi, v, g in x if len(v) == len(qv) and allow(qg, g)
        ]
        out[qi] = [xi for _, xi in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("match_on", [None, "g"])
def test_vector_topk_brute_force(spark, match_on):
    rng = np.random.default_rng(3)
    x = [(i, [float(v) for v in rng.integers(-2, 3, 6)], int(rng.random() < 0.7)) for i in range(700)]
    x += [(1000, [1.0, 2.0], 0), (1001, [0.0] * 6, 1)]
    q = [(i, [float(v) for v in rng.integers(-2, 3, 6)], i % 2) for i in range(40)]
    schema = "{} long, embedding array<double>, g int"
    qd, xd = spark.createDataFrame(q, schema.format("query_id")), spark.createDataFrame(x, schema.format("item"))
    hits = R.vector_topk(qd, xd, 7, 6, match_on=match_on, item_key="item").orderBy("query_id", "rank").collect()
    got = {}
    for h in hits:
        got.setdefault(h.query_id, []).append(h.item)
    assert got == brute(q, x, 7, (lambda a, b: a == b) if match_on else (lambda a, b: True))


def test_vector_topk_many_blocks(spark):
    from hybridq.plans.blockscan import CosineTopK, block_scan

    rng = np.random.default_rng(5)
    x = [(i, [float(v) for v in rng.normal(size=4)], 0) for i in range(300)]
    schema = "{} long, embedding array<double>, g int"
    q, d = spark.createDataFrame(x[:90], schema.format("query_id")), spark.createDataFrame(x, schema.format("item"))
    raw = block_scan(q, d, CosineTopK(3, 4, "query_id", "item"), "query_id long, item long, score double", "query_id", "item", query_block=20)
    got = {}
    for h in R.keep_top(raw, 3, item_key="item").orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append(h.item)
    assert got == brute(x[:90], x, 3)


def test_wide_cells_copy_little(spark, monkeypatch):
    """Forty blocks of queries: items are copied for sixteen blocks at once, and every block gets its answer."""
    from hybridq.plans import blockscan as B

    cells = []
    own = B._cells
    monkeypatch.setattr(B, "_cells", lambda *a: cells.append(own(*a)) or cells[-1])
    rng = np.random.default_rng(8)
    x = [(i, [float(v) for v in rng.normal(size=4)], i % 3) for i in range(400)]
    schema = "{} long, embedding array<double>, g int"
    q, d = spark.createDataFrame(x, schema.format("query_id")), spark.createDataFrame(x, schema.format("item"))
    for match_on, same in ((None, lambda a, b: True), ("g", lambda a, b: a == b)):
        task = B.CosineTopK(3, 4, "query_id", "item", B.SameGroup(match_on) if match_on else None)
        raw = B.block_scan(q, d, task, "query_id long, item long, score double", "query_id", "item", match_on, query_block=10)
        got = {}
        for h in R.keep_top(raw, 3, item_key="item").orderBy("query_id", "rank").collect():
            got.setdefault(h.query_id, []).append(h.item)
        assert got == brute(x, x, 3, same)
        assert cells[-1].where("_side = 1").count() == 3 * 400
        assert cells[-1].where("_side = 0").count() <= 400 * 8


def test_topk_edges(spark, sf):
    e = view(spark, sf, "embeddings").select(c("vec_id").alias("document_id"), "embedding")
    q = e.select(c("document_id").alias("query_id"), "embedding")
    assert R.vector_topk(q, e, 0, 64).count() == 0
    words = spark.createDataFrame([(1, "the of"), (2, "zzzz")], "query_id long, text string")
    docs = view(spark, sf, "documents").select(c("doc_id").alias("document_id"), "text")
    assert R.keyword_topk(words, docs).count() == 0


# ---------------------------------------------------------------------------
# Joins, filters, search
# ---------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_hot_key(spark, how):
    big = spark.range(3000).select(F.when(c("id") % 3 == 0, 1).otherwise(c("id") % 50).alias("k"), c("id").alias("v"))
    small = spark.range(40).select(c("id").alias("k"), (c("id") * 2).alias("w"))
    a = spread_join(big, small, ["k"], ["v"], how, target_rows=100)
    b = big.join(small, ["k"], how)
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_filters_with_small_pieces(spark, sf):
    q, rows = query_log(spark, sf), listings(spark, sf)
    for fn in (X.filter_candidates, X.topic_gate_skills, X.topic_gate_keywords):
        one = fn(q, rows).select("query_id", "id")
        many = fn(q, rows, target_rows=7).select("query_id", "id")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def loop_level(k, row, rows):
    """The relaxation loop for one query, as a loop."""
    names = ["salary", "experience", "location", "employment type", "remote"]
    drop = {"salary": ["salary_min", "salary_max"], "experience": ["experience_min", "experience_max"], "location": ["location"],
            "employment type": ["employment_type"], "remote": ["remote"]}

    def passes(k, l):
        if k["remote"] is not None and l.remote != k["remote"]:
            return False
        if k["location"] is not None and k["remote"] is not True and k["location"].lower() not in l.location.lower():
            return False
        lo, hi = k["salary_min"], k["salary_max"]
        if (lo is not None and l.salary_max < lo) or (hi is not None and l.salary_min > hi):
            return False
        lo, hi = k["experience_min"], k["experience_max"]
        if (hi is not None and l.experience_min > hi) or (lo is not None and l.experience_max < lo):
            return False
        return k["employment_type"] is None or l.employment_type == k["employment_type"]

    def topic(l):
        return not k["skills"] or {s.lower() for s in k["skills"]} & {s.lower() for s in l.skills}

    k, dropped = dict(k), []
    if any(passes(k, l) and topic(l) for l in rows):
        return 0, []
    for level, name in enumerate(names, start=1):
        if all(k[f] is None for f in drop[name]):
            continue
        k.update({f: None for f in drop[name]})
        dropped.append(name)
        if any(passes(k, l) and topic(l) for l in rows):
            return level, dropped
    return None, []


def test_relaxation_equals_loop(spark, sf):
    q, rows = query_log(spark, sf), listings(spark, sf)
    no_words = q.where(F.size("criteria.keywords") == 0)
    got = {r.query_id: (r.level, list(r.dropped)) for r in P.relax_filters(no_words, rows).collect()}
    all_rows = rows.collect()
    for r in no_words.collect():
        want = loop_level(r.criteria.asDict(), r, all_rows)
        assert (got[r.query_id][0], got[r.query_id][1]) == want, r


def test_search_invariants(spark, sf):
    q, rows = query_log(spark, sf), listings(spark, sf)
    index = index_build(rows)
    found = P.hybrid_search(q, rows, index, n=None).collect()
    assert all(0 <= r.score <= 1 + 1e-9 for r in found)
    for qid in {r.query_id for r in found}:
        mine = sorted((r for r in found if r.query_id == qid), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.score >= b.score - 1e-8 for a, b in zip(mine, mine[1:]))
        norms = [r.semantic_norm for r in mine if r.semantic_norm is not None]
        assert not norms or max(norms) <= 1 + 1e-9
        assert mine[0].total_matches >= len(mine)
    unknown = q.limit(1).withColumn("criteria", U.criteria_struct(skills=F.array(F.lit("Fortran"))))
    assert P.hybrid_search(unknown, rows, index).count() == 0


# ---------------------------------------------------------------------------
# Understanding
# ---------------------------------------------------------------------------
def test_parser_examples(spark):
    rows = [
        (1, "Find remote Java jobs with Spring Boot above 12 LPA", False),
        (2, "Data engineer roles in Bengaluru or Pune, 3-5 years, 10 to 15 lakhs", False),
        (3, "only those under 5 years experience", True),
        (4, "hello there", False),
        (5, "compare 1 and 3", True),
        (6, "What skills does the second job require?", True),
        (7, "I like to go hiking and express myself", False),
        (8, "not remote, part-time k8s work, tell me about #1042", False),
        (9, "show the last job", True),
        (10, "java.net and C#", False),
        (11, None, False),
    ]
    df = spark.createDataFrame(rows, "query_id long, text string, has_previous boolean")
    got = {r.query_id: r for r in U.parse_queries(df).collect()}
    k = {i: r.criteria for i, r in got.items()}
    assert k[1].skills == ["Java", "Spring Boot"] and k[1].remote is True and k[1].salary_min == 1_200_000
    assert k[2].location == "Bangalore" and (k[2].experience_min, k[2].experience_max) == (3, 5)
    assert (k[2].salary_min, k[2].salary_max) == (1_000_000, 1_500_000)
    assert got[3].intent == "REFINE" and k[3].experience_max == 4
    assert got[4].intent == "GENERAL"
    assert got[5].intent == "COMPARE" and got[5].ordinals == [1, 3]
    assert got[6].intent == "JOB_QUESTION" and got[6].ordinals == [2]
    assert k[7].skills == []
    assert k[8].remote is False and k[8].employment_type == "PART_TIME" and k[8].skills == ["Kubernetes"] and got[8].job_ids == [1042]
    assert got[9].ordinals == [-1]
    assert k[10].skills == ["Java", ".NET", "C#"]
    assert k[11].skills == [] and got[11].intent == "GENERAL"


# ---------------------------------------------------------------------------
# Sources, conversations, streams
# ---------------------------------------------------------------------------
def test_load_envelope(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"dataset": "x", "extra": 1,\n "jobs": [{"id": 1, "title": "t", "company": "c", "salaryMin": 5, "salaryMax": 3, "nope": 2}]}'
    )
    row = L.normalise_listings(L.load_listings(spark, str(tmp_path))).first()
    assert (row.location, row.employment_type, row.salary_max, row.skills) == ("Not specified", "FULL_TIME", 5, [])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.json").write_text('{"jobs": []}')
    with pytest.raises(ValueError):
        L.load_listings(spark, str(tmp_path / "b"))


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "ix")
    assert index_read(spark, path) is None
    rows = lambda n: spark.range(n).select(c("id").alias("document_id"), F.lit("SKILLS").alias("section"))
    manifest = spark.range(1).select(F.lit("local").alias("provider"))
    index_write(rows(3), manifest, path, 1)
    index_write(rows(5), manifest, path, 2)
    assert index_read(spark, path)[0].count() == 5
    # data without a manifest (a failed writer) is not visible, nor is an unknown format
    rows(9).write.partitionBy("section").parquet(f"{path}/data/version=3")
    manifest.select("*", F.lit(99).alias("format_version"), F.lit(4).cast("bigint").alias("version")).write.mode("append").parquet(f"{path}/manifest")
    assert index_read(spark, path)[0].count() == 5


def test_positions_across_buckets(spark):
    m = spark.range(500).select((c("id") * 7).alias("message_id"), (c("id") % 2).alias("conv_id"))
    for r in V.positions(m, bucket=16).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message_id", "position"))).alias("x")).collect():
        assert [x.position for x in r.x] == list(range(1, 251))


def test_late_trace_rows_are_dropped(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "at timestamp, intent string, ok boolean, duration double"
    batches = [[(at(10, 1), "a", True, 1.0)], [(at(12, 0), "a", True, 1.0)], [(at(10, 2), "a", False, 9.0), (at(12, 1), "a", False, 3.0)]]
    stream = None
    out = {}

    def keep(batch, _):
        for r in batch.collect():
            out[r.window_start] = (r.turns, r.error_share)

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.stream_trace_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 minutes")
        S.run_available(stream, keep, str(tmp_path / "cp"), "update")
    assert out[at(10, 0)] == (1, 0.0)
    assert out[at(12, 0)] == (2, 0.5)


def test_vocabulary_is_consistent():
    assert set(vocab.SKILL_ALIASES) <= set(vocab.SKILLS)
    assert set(vocab.EXACT_CASE_SKILLS) <= set(vocab.SKILLS)
