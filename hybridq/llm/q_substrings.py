"""op1: removal of repeated 400-byte strings from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq.llm.registry import query, table
from hybridq.llm.suffix_dedup import suffix_dedup


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
