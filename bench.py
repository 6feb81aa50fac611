"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up the session's code paths on the smallest scale and
is then timed to completion at the bench scale.  Inputs that a deployment keeps as
tables (listings, their index, the document index) are built once and timed as
their own entries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hybridq.operators import conversations, documents, embedding, retrieval  # noqa: E402
from hybridq.operators.filters import filter_candidates  # noqa: E402
from hybridq.operators.understanding import parse_queries  # noqa: E402
from hybridq.plans.search import hybrid_search  # noqa: E402
from hybridq.session import local_session  # noqa: E402
from hybridq.workload import tables as t  # noqa: E402
from hybridq.workload.q_search import document_keywords, hashed_index  # noqa: E402


def cases(spark, sf):
    # the bench files have a single row group each; spread them like a larger table's splits
    docs = t.base(spark, sf, "documents").repartition("doc_id")
    vectors = t.base(spark, sf, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    passages = t.base(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return {
        "listings": lambda: t.listings(spark, sf),
        "index_build": lambda: t.listing_index(spark, sf),
        "chunk_documents": lambda: documents.chunk_documents(docs),
        "embed_documents": lambda: embedding.embed_hashing(
            documents.chunk_documents(docs), ["doc_id", "document_id"]
        ),
        "document_index": lambda: hashed_index(spark, sf),
        "vector_topk": lambda: retrieval.vector_topk(asked, vectors, 20, 64, item_key="vec_id"),
        "keyword_index": lambda: document_keywords(spark, sf).postings,
        "keyword_topk": lambda: retrieval.keyword_topk(passages, document_keywords(spark, sf), 20),
        "raw_retrieve": lambda: retrieval.vector_topk(
            embedding.embed_hashing(passages, ["query_id"]), hashed_index(spark, sf), 20
        ),
        "parse_queries": lambda: parse_queries(t.view(spark, sf, "requests").repartition("query_id")),
        "filter_candidates": lambda: filter_candidates(t.query_log(spark, sf), t.listings(spark, sf)),
        "listing_words": lambda: t.words(spark, sf),
        "hybrid_search": lambda: hybrid_search(
            t.query_log(spark, sf), t.listings(spark, sf), t.listing_index(spark, sf), words=t.words(spark, sf)
        ),
        "conversation_summary": lambda: conversations.conversation_summary(t.view(spark, sf, "messages")),
        "recent_history": lambda: conversations.recent_history(t.view(spark, sf, "messages")),
    }


def run(spark, sf):
    out = {}
    for name, make in cases(spark, sf).items():
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, out[name], file=sys.stderr, flush=True)
    return out


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small) and small != sf:
        run(spark, small)
    times = run(spark, sf)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
