"""Plans and results of steps that must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from hybridq.functions.text import token_bigrams, tokenize
from hybridq.operators import embedding as E
from hybridq.operators import retrieval as R
from hybridq.operators.filters import topic_gate_keywords
from hybridq.operators.understanding import criteria_struct
from hybridq.plans.search import listed_ids
from hybridq.workload.tables import listing_facts, listings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(*names):
    return F.array(*[F.lit(n) for n in names])


# F9
def test_exploded_ids_are_never_broadcast(spark):
    limited = spark.createDataFrame([(1, [5, 6, 6]), (2, [])], "query_id long, restrict_ids array<long>")
    facts = spark.createDataFrame([(5,), (7,)], "id long")
    met = listed_ids(limited, ["query_id"]).join(facts, "id")
    assert "BroadcastHashJoin" not in plan(met)
    assert [tuple(r) for r in met.select("query_id", "id").collect()] == [(1, 5)]


# F12
def test_keyword_gate_makes_each_pair_once_and_without_distinct(spark):
    rows = [(1, "data data cloud"), (2, "aws plumbing"), (3, "nothing"), (3, "data")]
    catalogue = spark.createDataFrame(rows, "id long, title string").select(
        "id", "title", F.array().cast("array<string>").alias("skills"), F.lit("").alias("description"),
        *[F.array().cast("array<string>").alias(n) for n in ("requirements", "responsibilities")],
    )
    q = spark.range(1, 3).select(
        F.col("id").alias("query_id"),
        criteria_struct(keywords=F.when(F.col("id") == 1, words("data", "cloud")).otherwise(words("nothing"))).alias("criteria"),
    )
    found = topic_gate_keywords(q, catalogue)
    # listing 3 stands twice: what either row says counts for both
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (1, 3), (2, 3), (2, 3)]
    # the pairs leave the join as they are: nothing groups or shuffles them
    text = plan(found)
    assert text.index("Join") < text.index("Aggregate") and text.index("Join") < text.index("Exchange")


# F15
@pytest.mark.parametrize("hashed", [True, False])
def test_questions_meet_their_own_listing_by_a_join(spark, hashed):
    kind = "idx array<int>, val array<double>" if hashed else "embedding array<double>"
    vector = (lambda a, b: ([0, 1], [a, b])) if hashed else (lambda a, b: ([a, b],))
    index = spark.createDataFrame(
        [(1, "a", *vector(1.0, 0.0)), (1, "b", *vector(3.0, 4.0)), (2, "c", *vector(0.0, 2.0)), (None, "d", *vector(1.0, 1.0))],
        f"job_id long, document_id string, {kind}",
    )
    asked = spark.createDataFrame([(10, 1, *vector(0.0, 5.0)), (11, 2, *vector(1.0, 0.0)), (12, None, *vector(1.0, 0.0))], f"query_id long, job_id long, {kind}")
    found = R.retrieve_within(asked, index, 1, 2)
    assert "_cell" not in plan(found)
    assert sorted((r.query_id, r.document_id, round(r.score, 9), r["rank"]) for r in found.collect()) == [(10, "b", 0.8, 1), (11, "c", 0.0, 1)]


# F39
def test_bigrams_make_their_tokens_once(spark):
    df = spark.createDataFrame([("one two three",), ("one",), ("",), (None,)], "text string")
    out = df.select(token_bigrams(tokenize(F.col("text"))).alias("b"))
    assert [r.b for r in out.collect()] == [["one_two", "two_three"], [], [], []]
    # once as the value that the bigrams are made of
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


# F40, F44
def test_features_of_an_id_are_counted_across_parts_without_grouping(spark, monkeypatch):
    monkeypatch.setattr(E, "PART_ROWS", 2)
    rows = [(1, "cloud x"), (1, "x x"), (1, ""), (2, None), (None, "y"), (None, "y"), (3, "z")]
    df = spark.createDataFrame(rows, "k long, text string")
    w = E.feature_weights(df, ["k"])
    assert "Aggregate" not in plan(w) and "Aggregate" not in plan(E.hash_features(w, ["k"]))
    got = {(r.k, r.feature): r.weight for r in w.collect()}
    assert len(got) == w.count()
    assert got[(1, "x")] == pytest.approx(1 + 1.0986122886681098) and got[(None, "y")] == pytest.approx(1 + 0.6931471805599453)
    assert got[(1, None)] is None and got[(2, None)] is None and (3, None) not in got
    plain = {}
    for (k, f), v in got.items():
        if f is None:
            plain.setdefault((k, None), None)
            continue
        h = int(__import__("hashlib").md5(f.encode()).hexdigest()[:8], 16)
        plain[(k, h % 1024)] = plain.get((k, h % 1024), 0.0) + (-v if h >= 1 << 31 else v)
    sums = {(r.k, r.idx): r.w for r in E.hash_features(w, ["k"]).collect()}
    assert sums == {key: v if v is None else pytest.approx(v) for key, v in plain.items()}


# F37, F47, F48, F49, F50
def test_listing_facts_are_the_listings_without_their_texts(spark, sf):
    facts, whole = listing_facts(spark, sf), listings(spark, sf)
    assert facts.columns == [n for n in whole.columns if n != "description"]
    assert facts.exceptAll(whole.drop("description")).count() == 0 and facts.count() == whole.count()


def test_features_of_few_rows_are_held_at_once(monkeypatch):
    """however many rows a batch has, features are counted for PART_ROWS of them, and vectors stay the same."""
    import numpy as np
    import pyarrow as pa

    from hybridq.operators import embedding as E

    rng = np.random.default_rng(4)
    words = [[f"w{i}" for i in rng.integers(0, 40, rng.integers(0, 30))] for _ in range(2500)]
    concepts = [["aws", "gcp"][: len(w) % 3] for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(words, pa.list_(pa.string())), pa.array(concepts, pa.list_(pa.string()))], ["id", "_tokens", "_concepts"])
    sizes, own = [], E._sparse_vectors
    monkeypatch.setattr(E, "_sparse_vectors", lambda t, *a: sizes.append(len(t)) or own(t, *a))
    parts = pa.Table.from_batches(E._embedded(iter([batch]), 64)).to_pylist()
    assert sizes == [1000, 1000, 500] and [r["id"] for r in parts] == list(range(2500))
    monkeypatch.setattr(E, "PART_ROWS", 10_000)
    monkeypatch.setattr(E, "DENSE_CELLS", 0)
    monkeypatch.setattr(E, "KNOWN", 0)
    whole = pa.Table.from_batches(E._embedded(iter([batch]), 64)).to_pylist()
    assert [r["idx"] for r in parts] == [r["idx"] for r in whole]
    assert all(np.allclose(a["val"], b["val"], atol=1e-12) for a, b in zip(parts, whole))


def test_keyword_index_of_documents_makes_no_vectors(spark, sf, monkeypatch):
    """keywords ask for chunks, not for their vectors."""
    from hybridq.workload import q_search as Q

    monkeypatch.setattr(Q, "_KEYWORDS", {})
    monkeypatch.setattr(Q, "hashed_index", lambda *a: 1 / 0)
    assert Q.document_keywords(spark, sf).lists.count() > 0
