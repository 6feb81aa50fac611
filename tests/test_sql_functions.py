"""Functions and table functions called from SQL."""

import pytest
from pyspark.sql import functions as F

from hybridq.functions.chunking import split_text
from hybridq.functions.registry import register_functions

TEXTS = [
    None, "", " \n\t ", "One.", "One. Two! Three? Four", "a " * 40, "x" * 50 + " y. z", "Line\n\nline\nline. " * 4,
    "Short one. " + "long " * 12 + "end. Next one. And one more.", "\x00 a. b \x1f",
]


@pytest.fixture(scope="module")
def texts(spark):
    register_functions(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


@pytest.mark.parametrize("most", [5, 20, 60])
def test_chunks_from_sql(spark, texts, most):
    want = {r.id: r.c for r in texts.select("id", split_text(F.col("t"), most).alias("c")).collect()}
    scalar = spark.sql(f"SELECT id, text_chunks(t, {most}) AS c FROM {{x}}", x=texts)
    assert {r.id: r.c for r in scalar.collect()} == want
    table = spark.sql(f"SELECT x.id, p.* FROM {{x}} x, LATERAL split_text(x.t, {most}) p", x=texts)
    found = sorted((r.id, r.chunk_index, r.chunk) for r in table.collect())
    assert found == sorted((i, n, chunk) for i, c in want.items() for n, chunk in enumerate(c))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan


def test_sentences_from_sql(spark, texts):
    rows = spark.sql("SELECT x.id, s.* FROM {x} x, LATERAL text_sentences(x.t) s WHERE x.id IN (0, 1, 4)", x=texts).collect()
    assert [(r.sentence_index, r.sentence) for r in sorted(rows)] == [(0, "One."), (1, "Two!"), (2, "Three?"), (3, "Four")]


def test_cosine_from_sql(spark, texts):
    row = spark.sql(
        """SELECT cosine_similarity(array(3D, 4D), array(3D, 4D)) AS same, cosine_similarity(array(0D), array(1D)) AS zero,
        cosine_similarity(NULL, array(1D)) AS none, cosine_similarity(array(1D, 0D), array(0D, 2D)) AS across"""
    ).first()
    assert (row.same, row.zero, row.none, row.across) == (1.0, 0.0, None, 0.0)
