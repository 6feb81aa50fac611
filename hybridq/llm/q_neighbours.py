"""op5: the ten nearest vectors of every hundredth one."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq.llm.bit_codes import search
from hybridq.llm.registry import query, table


@query("op5_bit_code_neighbours")
def op5(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
