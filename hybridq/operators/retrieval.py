"""Exact top-k retrieval over chunks: dense or hashed vectors, and keywords."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq import vocab
from hybridq.functions.strings import round_half_up, strings
from hybridq.functions.vectors import cosine_similarity
from hybridq.operators.embedding import blank
from hybridq.operators.keywords import Keep, KeywordIndex, keyword_index, search_keywords
from hybridq.plans.blockscan import ITEM_ROWS, CosineTopK, SameGroup, block_scan, unit_matrix
from hybridq.plans.joins import TARGET_ROWS, spread_join
from hybridq.plans.stages import materialise


def order_key(score: Column) -> Column:
    """Scores are compared at nine decimals so equal vectors tie exactly."""
    return F.floor(score * F.lit(1e9) + F.lit(0.5))


def keep_top(hits: DataFrame, k: int | None, query_key: str = "query_id", item_key: str = "document_id") -> DataFrame:
    """Add rank and keep the first k per query (pruned before the shuffle; None keeps all)."""
    w = Window.partitionBy(query_key).orderBy(order_key(F.col("score")).desc(), F.col(item_key))
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _types(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _vector_columns(df: DataFrame) -> list[str]:
    return ["embedding"] if "embedding" in df.columns else ["idx", "val"]


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = vocab.RETRIEVAL_TOP_K,
    dims: int = vocab.DIMENSIONS,
    match_on: str | None = None,
    gate=None,
    gate_columns: tuple[list[str], list[str]] = ((), ()),
    item_key: str = "document_id",
    together: str | None = None,
) -> DataFrame:
    """(query_id, item, score, rank): exact cosine top-k per query.

    `match_on` restricts each query to items with the same value of that column;
    `gate` is any block-scan gate over the listed extra columns, `together` one of them that the
    items of one listing share.
    """
    extra = [match_on] if match_on else []
    q = queries.select("query_id", *_vector_columns(queries), *extra, *gate_columns[0])
    x = vectors.select(item_key, *_vector_columns(vectors), *extra, *gate_columns[1])
    if k <= 0:
        x = x.where(F.lit(False))
    task = CosineTopK(max(k, 1), dims, "query_id", item_key, SameGroup(match_on) if match_on else gate)
    schema = f"{_types(queries, 'query_id')}, {_types(vectors, item_key)}, score double"
    return keep_top(block_scan(q, x, task, schema, "query_id", item_key, match_on, together=together), k, item_key=item_key)


def vector_topk_pairs(
    queries: DataFrame,
    vectors: DataFrame,
    allowed: DataFrame,
    k: int = vocab.RETRIEVAL_TOP_K,
    on: str = "job_id",
    item_key: str = "document_id",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Top-k among an explicit candidate table (query_id, <on>): joined before scoring.

    Needs dense vectors on both sides (column `embedding`)."""
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    wanted = spread_join(allowed.select("query_id", on), q, ["query_id"], [on], target_rows=target_rows)
    # the larger side of the second join is the vectors: many chunks share one listing
    pairs = spread_join(vectors.select(on, item_key, "embedding"), wanted, [on], [item_key], target_rows=target_rows)
    same_size = F.size("_q") == F.size("embedding")
    scored = pairs.where(same_size).select(
        "query_id", item_key, cosine_similarity(F.col("_q"), F.col("embedding")).alias("score")
    )
    return keep_top(scored, k, item_key=item_key)


def keyword_topk(
    queries: DataFrame,
    chunks: DataFrame | KeywordIndex,
    k: int = vocab.RETRIEVAL_TOP_K,
    keep: Keep | None = None,
    item_key: str = "document_id",
) -> DataFrame:
    """(query_id, item, score, rank) by share of distinct query terms, damped by length.

    `chunks` are an index of operators/keywords.py, or a table to build one from.  `keep` filters pairs
    (query_id, item, ...) to those a query may see."""
    index = chunks if isinstance(chunks, KeywordIndex) else keyword_index(chunks, item_key)
    return search_keywords(queries, index, k, keep)


def topk_among(queries: DataFrame, index: DataFrame, allowed: DataFrame, k: int, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(query_id, document_id, score, rank): exact top-k of hashed vectors among allowed listings (query_id, job_id)."""
    q = queries.select("query_id", F.map_from_arrays("idx", "val").alias("_q"))
    # pairs by sorting: their number can't be told from the size of the tables they come from
    wanted = allowed.select("query_id", "job_id").distinct().hint("merge").join(q, "query_id").hint("merge")
    # many queries may be allowed one listing, and a listing may have many chunks
    pairs = spread_join(index.select("job_id", "document_id", "idx", "val"), wanted, ["job_id"], ["document_id"], target_rows=target_rows)
    products = F.zip_with("idx", "val", lambda i, v: v * F.coalesce(F.try_element_at("_q", i), F.lit(0.0)))
    dot = F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    return keep_top(pairs.select("query_id", "document_id", dot.alias("score")), k)


NO_QUERY = "Empty query"
NO_CANDIDATES = "No candidate jobs to search"
NO_INDEX = "Vector index is not ready yet"


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    manifest: DataFrame,
    query_vectors: DataFrame,
    k: int = vocab.RETRIEVAL_TOP_K,
    dims: int = vocab.DIMENSIONS,
    allowed: DataFrame | None = None,
    keywords: KeywordIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(modes, hits) for queries (query_id, text, n_candidates?).

    A query with a vector is answered by vector search, one without by keywords; blank queries, empty candidate
    sets and an empty index yield no hits.  `allowed` (query_id, job_id) are the listings each query may see, in
    both modes (none: no candidates); without it a query sees all.  `keywords` is the keyword index of the same chunks, with
    their job_id, where it is kept.
    """
    embedded = query_vectors.select("query_id", F.lit(True).alias("embedded")).distinct()
    if allowed is not None:
        allowed = materialise(allowed.select("query_id", "job_id").distinct(), "allowed")
        counted = allowed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
        queries = queries.drop("n_candidates").join(counted, "query_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    has_candidates = (
        (F.col("n_candidates").isNull() | (F.col("n_candidates") > 0)) if "n_candidates" in queries.columns else F.lit(True)
    )
    header = F.broadcast(
        index.select("document_id").limit(1).select(F.lit(1).alias("_one"))
        .join(manifest.limit(1).select(F.lit(1).alias("_one"), "provider"), "_one")
    )
    c = F.col
    modes = (
        queries.withColumn("_one", F.lit(1))
        .join(header, "_one", "left")
        .join(embedded, "query_id", "left")
        .select(
            "query_id",
            "text",
            F.when(blank(c("text")), "none").when(~has_candidates, "none").when(c("provider").isNull(), "none")
            .when(c("embedded"), "vector").otherwise("keyword").alias("mode"),
            F.when(blank(c("text")), NO_QUERY).when(~has_candidates, NO_CANDIDATES)
            .when(c("provider").isNull(), NO_INDEX).when(c("embedded"), F.lit(None).cast("string"))
            .otherwise(
                F.concat(F.lit("Embedding provider '"), c("provider"), F.lit("' unavailable; used keyword retrieval"))
            ).alias("note"),
        )
    )
    by_vector = query_vectors.join(modes.where(c("mode") == "vector").select("query_id"), "query_id", "left_semi")
    by_words = modes.where(c("mode") == "keyword").select("query_id", "text")
    if allowed is None:
        hits = vector_topk(by_vector, index, k, dims).unionByName(keyword_topk(by_words, keywords or index, k))
    else:
        keywords = keywords or keyword_index(index, carry=("job_id",))
        listed = keywords.lists.select("document_id", "job_id")
        keep = lambda pairs: pairs.join(listed, "document_id").join(allowed, ["query_id", "job_id"], "left_semi").drop("job_id")
        hits = topk_among(by_vector, index, allowed, k).unionByName(keyword_topk(by_words, keywords, k, keep))
    return modes.drop("text"), hits


def raw_retrieve(
    queries: DataFrame, index: DataFrame, k: int = 10, dims: int = vocab.DIMENSIONS, most: int | None = None
) -> DataFrame:
    """Inspection view over everything: the k best (one at least, `most` at most, if given), score at four decimals."""
    hits = vector_topk(queries, index, max(k, 1) if most is None else min(max(k, 1), most), dims)
    return hits.join(index.select("document_id", "job_id", "section", "text", "metadata"), "document_id").select(
        "query_id", "rank", "document_id", "job_id", "section",
        round_half_up(F.col("score"), 4).alias("similarity"), "metadata", "text",
    )


def retrieve_within(queries: DataFrame, index: DataFrame, k: int | None = 4, dims: int = vocab.DIMENSIONS) -> DataFrame:
    """Best chunks of one listing per question (k=None ranks all of them): queries (query_id, job_id, vector columns)."""
    if k is not None and k <= 0:
        return vector_topk(queries, index, k, dims)
    # a question meets the chunks of its listing only, as rows of one join
    own, others = _vector_columns(index), _vector_columns(queries)
    asked = queries.select("query_id", "job_id", *[F.col(n).alias(f"_q_{n}") for n in others])
    pairs = spread_join(index.select("job_id", "document_id", *own), asked, ["job_id"], ["document_id"])
    schema = f"{_types(queries, 'query_id')}, {_types(index, 'document_id')}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ITEM_ROWS):
                part = pa.Table.from_batches([batch.slice(low, ITEM_ROWS)])
                (q, usable), (x, also) = (unit_matrix(part.select(names).rename_columns(plain), dims) for names, plain in (
                    ([f"_q_{n}" for n in others], others), (own, own)))
                scored = part.select(["query_id", "document_id"]).append_column("score", pa.array((q * x).sum(axis=1)))
                yield from scored.filter(pa.array(usable & also)).to_batches()

    return keep_top(pairs.drop("job_id").mapInArrow(run, schema), k)


def best_chunk_per_listing(hits: DataFrame) -> DataFrame:
    """hits (query_id, job_id, document_id, section, score, rank) -> one row per listing.

    A query has at most k hits, which bounds every list."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "document_id", "section", "score")))
    return (
        hits.groupBy("query_id", "job_id")
        .agg(F.max("score").alias("best_score"), ordered.alias("chunks"))
    )


def source_refs(per_listing: DataFrame, listings: DataFrame) -> DataFrame:
    """(query_id, id, title, company, sections, similarity) for shown listings.

    `per_listing` has query_id, id and the chunk list (NULL or empty when nothing was retrieved)."""
    c = F.col
    sections = F.array_distinct(F.transform("chunks", lambda x: x.section))
    shown = per_listing.join(listings.select("id", "title", "company"), "id")
    none = F.coalesce(F.size("chunks"), F.lit(0)) <= 0
    return shown.select(
        "query_id", "id", "title", "company",
        F.when(none, strings(["STRUCTURED DATA"])).otherwise(sections).alias("sections"),
        F.when(~none, round_half_up(F.get(c("chunks"), F.lit(0)).score, 3)).alias("similarity"),
    )
