"""op2: all documents encoded to pieces and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hybridq.llm.piece_lattice import encode_documents
from hybridq.llm.registry import query, table


@query("op2_piece_lattice")
def op2(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = encode_documents(table(spark, sf_dir, "documents"), path, decode=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
