"""Ranked lexical search, reversed: the items are indexed and the documents stream through the index.

1. Items are cut into terms; their postings (term, item, occurrences) are staged.  Blocks of items
   with at most `block_postings` postings are searched one after the other; a benchmark is one block.
2. Every document is read once a block: its number of terms and the counts of the terms that
   some item has are staged.  Document frequencies are counted from there, and the
   totals of the corpus with them.
3. The index of the block (postings by term, term weights) is broadcast.  Each task streams its
   documents' term counts through it, adds up integer scores for a bounded rectangle of documents and
   items, and keeps a heap of the `k` best documents for each item.
4. The heaps of the tasks are merged in two levels, so no item's heaps meet in one task all at once.

What is broadcast or sent to the driver is bounded by `block_postings`, whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hybridq.llm.arrow import by_bytes, ids_array, slices, spans, text_bytes
from hybridq.plans.stages import drop_stage, materialise

TOP = 10
BLOCK_POSTINGS = 1_000_000
#: Documents x items scored at once, and postings expanded at once.
CELLS = 2_000_000
#: Groups of tasks whose heaps are merged first.
MERGE_GROUPS = 64
POSTINGS = "no long, term binary, times long"
COUNTS = "doc_id long, n long, codes array<int>, times array<int>"
HEAPS = "no long, doc_id long, score long"

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
IN_TERM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts one after the other, index of each text's first term, with the end)."""
    data, offsets = text_bytes(texts)
    inside = IN_TERM[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    opens[starts] = inside[starts]
    begin = np.flatnonzero(opens)
    # a term's bytes stand together once all other bytes are left out
    return slices(LOWER[data[inside]], np.cumsum(inside)[begin] - 1), np.searchsorted(begin, offsets)


def _grouped(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, occurrences) of each distinct pair, by owner and code."""
    width = int(code.max(initial=0)) + 1
    pair, times = np.unique(owner.astype(np.int64) * width + code, return_counts=True)
    return pair // width, pair % width, times


def _item_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        terms, first = terms_of(batch.column("text"))
        coded = terms.dictionary_encode()
        owner, code, times = _grouped(np.repeat(np.arange(batch.num_rows), np.diff(first)), np.asarray(coded.indices, dtype=np.int64))
        no = np.asarray(batch.column("no"))[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(no), coded.dictionary.take(pa.array(code)).cast(pa.binary()), pa.array(times.astype(np.int64))],
            ["no", "term", "times"],
        )


def _document_counts(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_binary())
        for batch in by_bytes(batches, "text"):
            terms, first = terms_of(batch.column("text"))
            code = np.asarray(pc.fill_null(pc.index_in(terms, value_set=known), -1), dtype=np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            owner, code, times = _grouped(owner[code >= 0], code[code >= 0])
            at = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (code, times)]
            found = pa.RecordBatch.from_arrays(
                [pa.array(ids_array(batch.column("doc_id"))), pa.array(np.diff(first).astype(np.int64)), *lists],
                ["doc_id", "n", "codes", "times"],
            )
            yield found.filter(pc.greater(found.column("n"), 0))

    return run


class Index:
    """Postings of a block of items by term code, term weights, and the totals of the corpus."""

    def __init__(self, nos: np.ndarray, code: np.ndarray, item: np.ndarray, times: np.ndarray, df: np.ndarray, documents: int, total: int):
        order = np.argsort(code, kind="stable")
        self.nos, self.item, self.times = nos, item[order], times[order]
        self.start = np.searchsorted(code[order], np.arange(len(df) + 1))
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        self.documents, self.total = documents, total
        # a term of a document adds less than a million times its weight
        most = np.bincount(item, times * self.weight[code], minlength=len(nos)).max(initial=0) * 1e6
        self.halves = most >= 2.0**53

    def norm(self, n: np.ndarray) -> np.ndarray:
        """m of documents with `n` terms."""
        factor = 75 * self.documents
        if int(n.max(initial=0)) * factor < 1 << 63:
            return 25 + n * factor // self.total
        return np.array([25 + x * factor // self.total for x in n.tolist()], dtype=np.int64)

    def scores(self, n: np.ndarray, owner: np.ndarray, code: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Documents x items; `owner` is the row of each (code, times)."""
        shape = (len(n), len(self.nos))
        part = self.weight[code] * (1_000_000_000 * times // (1000 * times + 8 * self.norm(n)[owner]))
        width = self.start[code + 1] - self.start[code]
        ends = np.cumsum(width)
        out = np.zeros(shape[0] * shape[1], dtype=np.int64)
        low = 0
        while low < len(code):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, side="right")))
            posting = spans(self.start[code[low:high]], width[low:high])
            cell = np.repeat(owner[low:high] * shape[1], width[low:high]) + self.item[posting]
            value = np.repeat(part[low:high], width[low:high]) * self.times[posting]
            if self.halves:  # sums of halves are exact in doubles
                out += np.bincount(cell, value >> 26, len(out)).astype(np.int64) << 26
                value &= (1 << 26) - 1
            out += np.bincount(cell, value, len(out)).astype(np.int64)
            low = high
        return out.reshape(shape)


class Heaps:
    """The k best (score, doc_id) of each item, smaller doc_id first where scores are equal."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)
        self.item = self.score = self.doc = np.empty(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        bar = self.floor
        if len(docs) > self.k:
            bar = np.maximum(bar, np.partition(scores, len(docs) - self.k, axis=0)[len(docs) - self.k])
        row, item = np.nonzero(scores >= bar)
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item) :]]])
        doc = np.concatenate([self.doc, docs[row]])
        order = np.lexsort((doc, -score, item))
        place = item[order]
        keep = order[np.arange(len(place)) - np.searchsorted(place, place) < self.k]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        last = np.searchsorted(self.item, np.arange(len(self.floor)), side="right") - 1
        full = np.bincount(self.item, minlength=len(self.floor)) == self.k
        self.floor[full] = self.score[last[full]]


def _stream(index, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        heaps = Heaps(len(ix.nos), k)
        step = max(1, CELLS // max(1, len(ix.nos)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                rows = batch.slice(low, step)
                lists = rows.column("codes")
                owner = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(lists)))
                code, times = (np.asarray(rows.column(c).flatten(), dtype=np.int64) for c in ("codes", "times"))
                heaps.offer(ix.scores(np.asarray(rows.column("n")), owner, code, times), np.asarray(rows.column("doc_id")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ix.nos[heaps.item]), pa.array(heaps.doc), pa.array(heaps.score)], ["no", "doc_id", "score"]
        )

    return run


def _heaps_of_block(spark: SparkSession, docs: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Staged heaps of the items of one block."""
    rows = postings.collect()  # at most block_postings, or those of one item
    vocabulary = sorted({bytes(r.term) for r in rows})
    code_of = {t: i for i, t in enumerate(vocabulary)}
    nos = np.array(sorted({r.no for r in rows}), dtype=np.int64)
    code = np.array([code_of[bytes(r.term)] for r in rows], dtype=np.int64)
    item = np.searchsorted(nos, np.array([r.no for r in rows], dtype=np.int64))
    times = np.array([r.times for r in rows], dtype=np.int64)
    known = spark.sparkContext.broadcast(vocabulary)
    counts = materialise(docs.mapInArrow(_document_counts(known), COUNTS), "counts")
    documents, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counts.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # one row a term of the block
        df[r["code"]] = r["count"]
    index = spark.sparkContext.broadcast(Index(nos, code, item, times, df, documents, total))
    heaps = materialise(counts.mapInArrow(_stream(index, k), HEAPS), "heaps")
    drop_stage(counts)
    return heaps


def reversed_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The `k` best documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score.

    Null and empty texts have no terms: such documents are not counted, such items find
    nothing.  Only scores above 0 count; equal scores go by ascending doc_id, a null doc_id first.  Repeated
    rows of `docs` are documents of their own, repeated rows of `items` items of their own (with
    the same item_id).  Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("no"), "item_id", "text"), "items")
    postings = materialise(numbered.select("no", "text").mapInArrow(_item_postings, POSTINGS), "postings")
    blocks = max(1, math.ceil(postings.count() / block_postings))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heaps = None
    for block in range(blocks):
        own = postings.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == block)
        part = _heaps_of_block(spark, texts, own, k)
        heaps = part if heaps is None else heaps.unionByName(part)
    best = [F.desc("score"), F.asc("doc_id")]
    group = Window.partitionBy("no", "_group").orderBy(*best)
    heaps = heaps.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    heaps = heaps.withColumn("_place", F.row_number().over(group)).where(F.col("_place") <= k)
    ranked = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*best))).where(F.col("rank") <= k)
    doc_id = F.when(F.col("doc_id") > F.lit(np.iinfo(np.int64).min), F.col("doc_id"))
    return ranked.join(numbered.select("no", "item_id"), "no").select("item_id", "rank", doc_id.alias("doc_id"), "score")
