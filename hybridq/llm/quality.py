"""Quality scores of documents: training on a bounded labelled sample, scoring of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hybridq.llm.byte_cnn import Model, keeper, scorer, train

#: Rows of each class that the model is fitted on, at most, and the longest of their texts.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 20_000
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model, fitted on rows of `labels` (doc_id, quality) that are not held out.

    The sample is the first `sample_rows` labelled documents of each class by a hash of doc_id, among those
    with texts of `sample_bytes` at most: a bound of 2 * sample_rows * sample_bytes whatever the corpus
    size.  Labels that are null, not 0 or 1, or contradict each other teach nothing.
    """
    clean = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
        .where("y = y2")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = {r.y: r["count"] for r in clean.groupBy("y").count().collect()}

    def pick(y: int) -> DataFrame:
        # a share by hash first, so that few rows are sorted however many are labelled
        share = min(1.0, 4 * sample_rows / max(known.get(y, 0), 1))
        few = clean.where((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40))))
        return few.orderBy(*order).limit(2 * sample_rows).select("doc_id", "y")

    picked = [pick(y) for y in (0, 1)]
    # at most 4 * sample_rows ids: a proven bound
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    found = texts.join(chosen, "doc_id")
    best = [found.where(F.col("y") == y).orderBy(*order, F.col("text")).limit(sample_rows) for y in (0, 1)]
    rows = best[0].unionByName(best[1]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text.encode() for r in rows], [r.y for r in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, held_out, score, predicted; one row per row, null text as empty.

    A narrow projection: no shuffle, whatever the keys look like.
    """
    ddl = "doc_id long, held_out boolean, score double"
    scored = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(scorer(model), ddl)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, unchanged; no shuffle."""
    return docs.mapInArrow(keeper(model, threshold), docs.schema)
