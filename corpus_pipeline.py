"""The training corpus, stage by stage.

Each stage works on all rows the one before it kept, is written as Parquet to the shared
folder, and is read again by the next.  All stages but the last return the columns of
`documents`; the last returns packed sequences.
"""

from __future__ import annotations

import public_tokenizers

from hybridq.llm.exact_dedup import distinct_documents
from hybridq.llm.jaccard_join import one_per_component
from hybridq.llm.packing import pack
from hybridq.llm.quality import fit, good_documents
from hybridq.llm.suffix_dedup import without_repeats
from hybridq.plans.stages import materialise

#: Fifty words of five bytes each: what counts as a repeated passage in this corpus.  (The query op1
#: keeps the 400 bytes of its own contract.)
REPEAT_BYTES = 256


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(docs, fit(docs, labels))


def exact_copies(spark, docs, sf_dir):
    """Of texts that are equal up to white space, the smallest doc_id stays."""
    return distinct_documents(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each component of near copies stays."""
    return one_per_component(docs)


def repeated_strings(spark, docs, sf_dir):
    """Strings of REPEAT_BYTES bytes that stand in more than one place are cut out."""
    return without_repeats(docs, window=REPEAT_BYTES)


def packing(spark, docs, sf_dir):
    """Pieces of documents in sequences of up to 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_strings", repeated_strings),
    ("packing", packing),
]

#: A trained network and suffix arrays can't be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
