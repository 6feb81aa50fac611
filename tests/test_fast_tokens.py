"""Tokens made in tasks are those of the Column functions; hashes, skills and blanks are what they were."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hybridq import vocab
from hybridq.functions import text as X
from hybridq.functions.hashing import BLOCK_BYTES, md5_heads
from hybridq.functions.strings import strip
from hybridq.operators import embedding as E, keywords as K, understanding as U
from hybridq.workload import tables as T

WORDS = ["Spring Boot", "C#", "asp.NET", "K8s", "ci/cd,", "developers", "class", "buses", "The", "cloud", "fullstack", "Kotlin", "İstanbul",
         "naïve", "a_b", "ai", "\u0000", "\x1c", "\n\n", "full-stack", "résumé", "REST APIs", "+", "x" * 70, "ΣΣ", "node.js"]


def rows():
    rng = np.random.default_rng(7)
    texts = [" ".join(WORDS[i] for i in rng.integers(0, len(WORDS), rng.integers(0, 40))) for _ in range(300)]
    return [(i, t) for i, t in enumerate([*texts, "", None, "  ", "the", "reactjs" * 3, "power bi" + " " + "jobs"])]


# F35, F36, F42, F51
def test_tokens_of_tasks_are_those_of_the_columns(spark, monkeypatch):
    monkeypatch.setattr(X, "TEXT_BYTES", 500)
    df = spark.createDataFrame(rows(), "id long, text string")
    tokens = df.withColumn("t", X.tokenize(F.col("text"))).withColumn("c", X.concept_terms(F.col("t"))).orderBy("id").collect()
    texts = pa.array([t for _, t in rows()])
    for tokenizer in (X.Tokenizer(), X.Tokenizer(0)):
        for _ in range(2):
            own, concepts = tokenizer.lists(texts)
            assert own.to_pylist() == [r.t for r in tokens] and concepts.to_pylist() == [r.c for r in tokens]
    assert X.Tokenizer().lists(texts.slice(5, 9))[0].to_pylist() == [r.t for r in tokens[5:14]]
    assert X.Tokenizer().lists(pa.array([], pa.string()))[0].to_pylist() == []


def test_bytes_that_are_no_text_part_words_and_keep_rows_apart(spark):
    texts = pa.array([b"a1\xffb1", b"c1", b"\xff"], pa.binary())
    assert X.Tokenizer().lists(texts)[0].to_pylist() == [["a1", "b1"], ["c1"], []]


def test_hashes_are_md5():
    texts = ["x" * n + "é" * (n % 2) for n in range(BLOCK_BYTES + 20)] + ["", "a_b"]
    want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts]
    assert md5_heads(pa.array(texts)).tolist() == want and md5_heads(pa.array(texts).slice(3, 9)).tolist() == want[3:12]
    assert md5_heads(pa.array([], pa.string())).tolist() == []


def test_vectors_make_tokens_in_their_own_tasks(spark):
    df = spark.createDataFrame(rows(), "id long, text string")
    out = E.with_vectors(df)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.id: dict(zip(r.idx, r.val)) for r in out.collect()}
    weights = E.hash_features(E.feature_weights(df, ["id"]), ["id"]).where("idx IS NOT NULL AND w <> 0").collect()
    want = {}
    for r in weights:
        want.setdefault(r.id, {})[r.idx] = r.w
    for i, _ in rows():
        norm = np.sqrt(sum(w * w for w in want.get(i, {}).values()))
        assert set(found[i]) == set(want.get(i, {})) and all(abs(found[i][b] - w / norm) < 1e-12 for b, w in want.get(i, {}).items())


# F34
def test_listed_terms_are_the_keyword_terms(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "id long, text string")
    want = {r.id: (r.n_tokens, r.terms) for r in K.keyword_terms(df).where("n_tokens > 0").collect()}
    monkeypatch.setattr(K, "LISTED_ROWS", 7)
    listed = K._listed(df, ["id"])
    assert "split(" not in listed._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: (r.n_tokens, r.terms) for r in listed.collect()} == want


# F43
def test_messages_are_dealt_out_before_they_are_read(spark, sf):
    plan = U.parse_queries(T.view(spark, sf, "requests"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_a_place_is_looked_behind_once_for_all_skills(spark):
    assert U.SKILL_PATTERN.count("(?<![A-Za-z0-9])") == 1
    parts = []
    for skill, form in U._surface_forms():
        body = re.escape(form).replace("/", r"\/")
        body = f"(?-i:{body})" if form == skill and skill in vocab.EXACT_CASE_SKILLS else body
        lead = "(?<![A-Za-z0-9])"
        parts.append((lead if form[0].isalnum() else rf"(?:{lead}|\G(?<=[A-Za-z0-9+#.]{{4}}))") + body)
    each = f"(?i)(?:{'|'.join(parts)})(?![A-Za-z0-9#])"
    rng = np.random.default_rng(3)
    forms = [f for _, f in U._surface_forms()]
    texts = [("", " ", "/", ".")[k % 4].join(str.upper(forms[i]) if i % 3 == k % 3 else forms[i] for i in rng.integers(0, len(forms), 8)) for k in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, "asp.net core", "Java.NET", "x.net", "C#C#", ".net.net", "k8sſ"]], "text string")
    found = df.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", U.SKILL_PATTERN), ("b", each))]).collect()
    assert [r.a for r in found] == [r.b for r in found]


def test_blanks_are_dropped_from_both_ends(spark):
    texts = [" a b ", "\x00\x1f\t\n a", "", "\x20\x00", " a ", "a  ", None, " \né\r"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip(F.col("t"))).collect()]
    assert got == [None if t is None else re.sub(r"^[\x00-\x20]+|[\x00-\x20]+\Z", "", t) for t in texts]
