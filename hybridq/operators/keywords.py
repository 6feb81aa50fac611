"""Keyword retrieval through an inverted index with blocks of falling impact.

A chunk scores (asked terms it holds / asked terms) x its damping, which falls with its length.  So the postings of
a term stand by damping, in blocks of up to BLOCK chunks, and a block's first chunk bounds all others.

1. The rarest asked terms give some chunks; the k-th of their exact scores is a floor that the k-th result
   can't miss.
2. Terms are left out, the most frequent first, as long as a chunk that holds nothing but them stays below the
   floor.  Of the other terms those blocks are read whose bound reaches it.
3. A chunk found this way counts the terms that were left out in its own list, unless even all of
   them can't lift it to the floor.

Chunks that no asked term names, and long lists of frequent words, are never read.  Nothing is collected; a term
that a third of the chunks hold is cut into blocks by range, and met in SLOTS pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq import vocab
from hybridq.functions.text import Tokenizer, offsets, tokenize
from hybridq.plans.stages import drop_stage, materialise

BLOCK = 128
SLOTS = 8
#: Blocks of rare terms that are read for the floor, and chunks (times k) whose exact scores are looked at for it.
PROBE_BLOCKS = 32
PROBED = 4
#: Chunks whose terms are listed at once.
LISTED_ROWS = 1000
#: Scores closer than this are compared exactly, at the end.
SLACK = 1e-9


class KeywordIndex(NamedTuple):
    """postings: term, block, impact, items, lengths; lists: item, n_tokens, terms, ...; vocabulary: term, df, first, impact, blocks."""

    postings: DataFrame
    lists: DataFrame
    vocabulary: DataFrame
    item_key: str = "document_id"


def keyword_terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    tokens = F.col("tokens")
    return df.withColumn("tokens", tokenize(F.col(text_col))).select(
        "*", F.array_distinct(tokens).alias("terms"), F.size(tokens).alias("n_tokens")
    )


def _listed(chunks: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """(kept, n_tokens, terms) of chunks with tokens: keyword_terms of a whole table, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer()
        for batch in batches:
            for low in range(0, batch.num_rows, LISTED_ROWS):
                part = batch.slice(low, LISTED_ROWS)
                row, code = tokenizer.coded(part.column("_text_"))
                some, place, n = np.unique(row, return_inverse=True, return_counts=True)
                width = len(tokenizer.names) + 1
                first = np.sort(np.unique(row * width + code, return_index=True)[1])  # terms in the order they appear
                used, at = np.unique(code[first], return_inverse=True)
                terms = pa.array([tokenizer.names[c] for c in used.tolist()], pa.string()).take(pa.array(at))
                rows = part.take(pa.array(some))
                lists = pa.ListArray.from_arrays(offsets(place[first], len(some)), terms)
                columns = [*(rows.column(c) for c in kept), pa.array(n, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "terms"])

    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in kept)
    texts = chunks.select(*kept, F.col(text_col).cast("string").alias("_text_"))
    return texts.mapInArrow(run, f"{schema}, n_tokens int, terms array<string>")


def damping(n_tokens: Column) -> Column:
    return 1 + F.log1p(n_tokens / 50.0)


def _cut(size: int, item_key: str):
    """Blocks of up to `size` neighbouring postings of one term, numbered in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.asarray(batch.column("term").dictionary_encode().indices)
            opens = np.flatnonzero(np.append(True, np.diff(code) != 0))
            place = np.arange(batch.num_rows) - np.repeat(opens, np.diff(np.append(opens, batch.num_rows)))
            starts = np.flatnonzero(place % size == 0)
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            items, lengths = (pa.ListArray.from_arrays(offsets, batch.column(c)) for c in (item_key, "n_tokens"))
            columns = [batch.column("term").take(pa.array(starts)), pa.array(number + np.arange(len(starts))), items, lengths]
            number += len(starts)
            yield pa.RecordBatch.from_arrays(columns, ["term", "block", "items", "lengths"])

    return run


def keyword_index(chunks: DataFrame, item_key: str = "document_id", carry: tuple[str, ...] = (), block: int = BLOCK) -> KeywordIndex:
    """The index of chunks (<item>, text, ...), staged; `carry` are columns of the chunks to keep with their lists."""
    lists = materialise(_listed(chunks, [item_key, *carry]), "lists")
    each = lists.select(F.explode("terms").alias("term"), "n_tokens", item_key)
    order = ["term", "n_tokens", item_key]
    kind = lists.schema[item_key].dataType.simpleString()
    placed = each.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = placed.mapInArrow(_cut(block, item_key), f"term string, block long, items array<{kind}>, lengths array<int>")
    impact = 1 / damping(F.element_at("lengths", 1))
    postings = materialise(blocks.withColumn("impact", impact), "postings")
    vocabulary = postings.groupBy("term").agg(
        F.sum(F.size("items")).alias("df"), F.min("block").alias("first"), F.max("impact").alias("impact"), F.count(F.lit(1)).alias("blocks")
    )
    return KeywordIndex(postings, lists, materialise(vocabulary, "vocabulary"), item_key)


def _each(blocks: DataFrame, item_key: str, *more: str) -> DataFrame:
    pair = F.explode(F.arrays_zip("items", "lengths")).alias("_p")
    return blocks.select("query_id", *more, pair).select(
        "query_id", *more, F.col("_p.items").alias(item_key), F.col("_p.lengths").alias("n_tokens")
    )


def _ranked(scored: DataFrame, k: int, item_key: str) -> DataFrame:
    key = F.floor(F.col("score") * F.lit(1e9) + F.lit(0.5))
    w = Window.partitionBy("query_id").orderBy(key.desc(), F.col(item_key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_scores(pairs: DataFrame, asked: DataFrame, index: KeywordIndex) -> DataFrame:
    """(query_id, item, score) of pairs, from the items' own lists."""
    own = pairs.select("query_id", index.item_key).join(asked.select("query_id", F.col("terms").alias("_asked")), "query_id")
    hits = F.size(F.array_intersect("_asked", "terms"))
    score = hits / F.size("_asked") / damping(F.col("n_tokens"))
    return own.join(index.lists.select(index.item_key, "n_tokens", "terms"), index.item_key).select("query_id", index.item_key, score.alias("score"))


Keep = Callable[[DataFrame], DataFrame]


class Search(NamedTuple):
    """A plan of one search: what is asked, the floors, and the blocks to read."""

    asked: DataFrame
    named: DataFrame
    essential: DataFrame
    read: DataFrame


def plan_search(queries: DataFrame, index: KeywordIndex, k: int, keep: Keep | None = None) -> Search:
    """Steps 1 and 2; `keep` filters pairs (query_id, item) to those a query may see."""
    asked = keyword_terms(queries).where(F.size("terms") > 0).select("query_id", "terms")
    asked = materialise(asked, "asked")
    named = asked.select("query_id", F.size("terms").alias("m"), F.explode("terms").alias("term")).join(index.vocabulary, "term")
    named = materialise(named, "named")
    # the rarest terms, up to PROBE_BLOCKS blocks of them, and one block of the rarest in any case
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    probes = named.withColumn("_so_far", F.sum("blocks").over(rarest)).withColumn("_place", F.count(F.lit(1)).over(rarest))
    whole = F.col("_so_far") <= PROBE_BLOCKS
    probes = probes.where(whole | (F.col("_place") == 1)).select("query_id", "m", "term", F.when(~whole, F.col("first")).alias("_only"))
    tops = probes.join(index.postings.drop("impact"), "term").where(F.col("_only").isNull() | (F.col("_only") == F.col("block")))
    seen = _each(tops, index.item_key, "m").groupBy("query_id", index.item_key).agg(
        F.count(F.lit(1)).alias("hits"), F.first("m").alias("m"), F.first("n_tokens").alias("n_tokens")
    )
    seen = seen if keep is None else keep(seen)
    some = _ranked(seen.withColumn("score", F.col("hits") / F.col("m") / damping(F.col("n_tokens"))), PROBED * k, index.item_key)
    floors = _ranked(exact_scores(some, asked, index), k, index.item_key).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    # terms by falling frequency; the first ones are left out while they can't reach the floor
    so_far = Window.partitionBy("query_id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.count(F.lit(1)).over(so_far) / F.col("m") * F.max("impact").over(so_far)
    ranked = named.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    ranked = ranked.withColumn("_left_out", bound + SLACK < F.col("floor"))
    ranked = ranked.withColumn("left_out", F.sum(F.col("_left_out").cast("int")).over(Window.partitionBy("query_id")))
    essential = materialise(ranked.where(~F.col("_left_out")).select("query_id", "m", "term", "floor", "left_out"), "essential")
    slot = F.pmod("block", F.lit(SLOTS)).alias("_slot")
    wanted = essential.withColumn("_slot", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SLOTS)])))
    read = index.postings.select("*", slot).join(wanted, ["term", "_slot"]).where(F.col("impact") + SLACK >= F.col("floor"))
    return Search(asked, named, essential, read)


def search_keywords(queries: DataFrame, index: KeywordIndex, k: int = vocab.RETRIEVAL_TOP_K, keep: Keep | None = None) -> DataFrame:
    """(query_id, item, score, rank): the k best items of each query (query_id, text) among those `keep` leaves it."""
    item = index.item_key
    if k <= 0:
        return queries.select("query_id").join(index.lists.select(item).limit(0), F.lit(True)).select("query_id", item, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    plan = plan_search(queries, index, k, keep)
    found = _each(plan.read, item, "m", "floor", "left_out").groupBy("query_id", item).agg(
        F.count(F.lit(1)).alias("hits"), *[F.first(c).alias(c) for c in ("m", "floor", "left_out", "n_tokens")]
    )
    reach = (F.col("hits") + F.col("left_out")) / F.col("m") / damping(F.col("n_tokens"))
    found = found.where(reach + SLACK >= F.col("floor"))
    found = found if keep is None else keep(found)
    found = materialise(found, "found")
    whole = found.where("left_out = 0").select("query_id", item, (F.col("hits") / F.col("m") / damping(F.col("n_tokens"))).alias("score"))
    scored = whole.unionByName(exact_scores(found.where("left_out > 0"), plan.asked, index))
    ranked = materialise(_ranked(scored, k, item), "keyword_hits")
    for stage in (found, plan.asked, plan.named, plan.essential):
        drop_stage(stage)
    return ranked


def search_work(queries: DataFrame, index: KeywordIndex, k: int = vocab.RETRIEVAL_TOP_K) -> DataFrame:
    """(query_id, blocks, blocks_read): blocks of all asked terms, and those read for the results (besides the probes)."""
    plan = plan_search(queries, index, k)
    blocks = plan.named.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
    return blocks.join(plan.read.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_read")), "query_id", "left")
