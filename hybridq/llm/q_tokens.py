"""op7 and op10: packing and token files over all documents."""

from __future__ import annotations

import public_tokenizers

from hybridq.llm.packing import pack
from hybridq.llm.registry import query, table
from hybridq.llm.token_files import read_tokens, write_tokens


@query("op7_hierarchical_packing")
def op7(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op10_token_files")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return read_tokens(*write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))
