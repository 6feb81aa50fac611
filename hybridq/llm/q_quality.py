"""op4: quality scores of all documents."""

from __future__ import annotations

from hybridq.llm.quality import fit, score_documents
from hybridq.llm.registry import query, table


@query("op4_byte_cnn_quality")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
