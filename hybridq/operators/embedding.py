"""Offline feature-hashing embedder, pluggable embedders and the embedded index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hybridq import vocab
from hybridq.functions.hashing import md5_heads
from hybridq.functions.strings import strip
from hybridq.functions.text import Tokenizer, concept_terms, offsets, tokenize

#: Rows whose features are counted at once.
PART_ROWS = 1000
#: Tokens that a task remembers, and cells (rows x dims) that are added up in a matrix.
KNOWN = 1 << 18
DENSE_CELLS = 1 << 21


def tokens_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("tokens", tokenize(F.col(text_col)))


def feature_weights(df: DataFrame, id_cols: list[str], text_col: str = "text", place: bool = True) -> DataFrame:
    """(ids, feature, weight).

    Texts are placed and sorted by id once; features are counted id by id as the texts pass,
    so they never cross the network and no task groups all of its features at once.  `place=False` is for rows that are
    already partitioned by some of the ids.
    """
    placed = df.select(*id_cols, F.col(text_col).alias("_text"))
    if place:
        placed = placed.repartition(*id_cols)
    # rows of one id stand together, so a task holds the features of one id and one slice
    words = placed.sortWithinPartitions(*id_cols).withColumn("_tokens", tokenize(F.col("_text"))).drop("_text")
    words = words.withColumn("_concepts", concept_terms(F.col("_tokens")))

    def entries(part: pa.RecordBatch):
        row, name, tf, names = _features(part.column("_tokens"), part.column("_concepts"))
        bare = np.setdiff1d(np.arange(part.num_rows), row)  # an empty text has the feature NULL
        rows, codes = np.concatenate([row, bare]), np.concatenate([name, np.full(len(bare), len(names))])
        return rows, codes, np.concatenate([tf, np.full(len(bare), np.nan)]), [*names, None]

    def rows(keys: pa.Table, group, name, tf, names) -> pa.RecordBatch:
        weight = np.where(tf < 1, tf, 1 + np.log(np.maximum(tf, 1)))
        features = pa.array(names, pa.string()).take(pa.array(name))
        columns = [*(keys.column(c).take(pa.array(group)).combine_chunks() for c in id_cols), features, pa.array(weight, mask=np.isnan(tf))]
        return pa.RecordBatch.from_arrays(columns, [*id_cols, "feature", "weight"])

    return words.mapInArrow(_by_id(id_cols, entries, rows), f"{_schema(df, id_cols)}, feature string, weight double")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in columns)


def _by_id(id_cols: list[str], entries, rows):
    """For batches whose equal ids are neighbours: the values of each (id, name) added up, also across batches.

    `entries` turns a part into (row, name, value, names), `rows` the sums into a batch; NULL values (NaN
    here) add nothing.  Held are the sums of one part and of the last id, whose rows may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (its ids, names, sums)
        for batch in batches:
            for low in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(low, PART_ROWS)
                keys = pa.Table.from_batches([part.select(id_cols)])
                if last is not None:
                    keys = pa.concat_tables([last[0], keys])
                changes = np.zeros(len(keys), dtype=bool)
                for c in id_cols:
                    code = np.asarray(keys.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices)
                    changes[1:] |= code[1:] != code[:-1]
                group = np.cumsum(changes)
                row, name, value, names = entries(part)
                row = group[row + (last is not None)]
                if last is not None:
                    row = np.concatenate([np.zeros(len(last[1]), dtype=np.int64), row])
                    name = np.concatenate([len(names) + np.arange(len(last[1])), name])
                    value, names = np.concatenate([last[2], value]), [*names, *last[1]]
                number = {n: i for i, n in enumerate(dict.fromkeys(names))}
                row, name, value = _summed_known(row, np.array([number[n] for n in names], dtype=np.int64)[name], value)
                names, end = list(number), group[-1]
                done = row < end
                keys = keys.take(pa.array(np.flatnonzero(np.append(True, changes[1:]))))
                if done.any():
                    yield rows(keys, row[done], name[done], value[done], names)
                last = keys.slice(int(end), 1), [names[i] for i in name[~done].tolist()], value[~done]
        if last is not None and len(last[1]):
            n = np.arange(len(last[1]))
            yield rows(last[0], np.zeros(len(n), dtype=np.int64), n, last[2], last[1])

    return run


def _summed_known(rows: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like _summed, where NaN stands for NULL: ignored, unless a (row, key) has nothing else."""
    known = ~np.isnan(values)
    at, key, total = _summed(rows, keys, np.where(known, values, 0.0))
    seen = _summed(rows, keys, known.astype(np.float64))[2]
    return at, key, np.where(seen > 0, total, np.nan)


def hash_features(weights: DataFrame, id_cols: list[str], dims: int = vocab.DIMENSIONS) -> DataFrame:
    """(ids, idx, w): signed weights summed per bucket.  A NULL idx marks an empty text.

    Neighbouring features of an id are added up where they are, so lists of buckets cross the network, not features."""

    def buckets(names: list) -> tuple[np.ndarray, np.ndarray]:
        h = np.array([-1 if f is None else int(hashlib.md5(f.encode()).hexdigest()[:8], 16) for f in names], dtype=np.int64)
        return np.where(h < 0, -1, h % dims), np.where(h >= 1 << 31, -1.0, 1.0)

    def hashed(part: pa.RecordBatch):
        coded = part.column("feature").dictionary_encode(null_encoding="encode")
        at, sign = buckets(coded.dictionary.to_pylist())
        code = np.asarray(coded.indices, dtype=np.int64)
        value = part.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.arange(part.num_rows), at[code] + 1, value * sign[code], range(-1, dims)

    def packed(keys: pa.Table, group, name, value, names) -> pa.RecordBatch:
        idx = np.array(names, dtype=np.int64)[name]
        first = np.flatnonzero(np.append(True, np.diff(group) != 0))
        offsets = pa.array(np.append(first, len(group)).astype(np.int32))
        lists = [pa.array(idx, pa.int32(), mask=idx < 0), pa.array(value, mask=np.isnan(value))]
        columns = [keys.column(c).take(pa.array(group[first])).combine_chunks() for c in id_cols]
        return pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(offsets, v) for v in lists)], [*id_cols, "_idx", "_w"])

    def unpacked(part: pa.RecordBatch):
        row, idx = _cells(part.column("_idx"))
        value = _cells(part.column("_w"))[1].to_numpy(zero_copy_only=False).astype(np.float64)
        return row, np.asarray(idx.fill_null(-1), dtype=np.int64) + 1, value, range(-1, dims)

    def rows(keys: pa.Table, group, name, value, names) -> pa.RecordBatch:
        idx = np.array(names, dtype=np.int64)[name]
        columns = [keys.column(c).take(pa.array(group)).combine_chunks() for c in id_cols]
        return pa.RecordBatch.from_arrays([*columns, pa.array(idx, pa.int32(), mask=idx < 0), pa.array(value, mask=np.isnan(value))], [*id_cols, "idx", "w"])

    ids = _schema(weights, id_cols)
    own = weights.select(*id_cols, "feature", F.col("weight").cast("double").alias("weight"))
    lists = own.mapInArrow(_by_id(id_cols, hashed, packed), f"{ids}, _idx array<int>, _w array<double>")
    placed = lists.repartition(*id_cols).sortWithinPartitions(*id_cols)
    return placed.mapInArrow(_by_id(id_cols, unpacked, rows), f"{ids}, idx int, w double")


def embed_hashing(
    df: DataFrame, id_cols: list[str], text_col: str = "text", dims: int = vocab.DIMENSIONS
) -> DataFrame:
    """(ids, idx array<int>, val array<double>): sparse unit vectors, zero vectors empty; a row for each row.

    feature_weights and hash_features are the same computation with a row for each feature.
    """
    return with_vectors(df.select(*id_cols, F.col(text_col).alias("_text")), "_text", dims).drop("_text")


def with_vectors(df: DataFrame, text_col: str = "text", dims: int = vocab.DIMENSIONS) -> DataFrame:
    """`df` with idx and val, in one pass over Arrow batches: no shuffle; tokens are made in the same tasks, and each distinct feature of PART_ROWS rows is hashed once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _embedded(_with_tokens(batches), dims)

    texts = df.withColumn("_text_", F.col(text_col).cast("string"))
    return texts.mapInArrow(run, f"{schema}, idx array<int>, val array<double>")


def _with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with `_tokens` and `_concepts` in place of `_text_`."""
    tokenizer = Tokenizer(KNOWN)
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "_text_"]
        for low in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(low, PART_ROWS)
            lists = tokenizer.lists(part.column("_text_"))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *lists], [*kept, "_tokens", "_concepts"])


def _embedded(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Features are held for PART_ROWS rows at a time, however many rows a batch has."""
    for batch in batches:
        kept = [n for n in batch.schema.names if n not in ("_tokens", "_concepts")]
        for low in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(low, PART_ROWS)
            idx, val = _sparse_vectors(part.column("_tokens"), part.column("_concepts"), dims)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), idx, val], [*kept, "idx", "val"])


def _cells(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _features(tokens: pa.ListArray, concepts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, feature, term frequency) of each feature of each row, and the features' names."""
    rows, feature, tf, names = _counted(tokens, concepts)
    return rows, feature, tf, names.to_pylist()


def _counted(tokens: pa.ListArray, concepts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    (row, words), (concept_row, terms) = _cells(tokens), _cells(concepts)
    if pa.types.is_dictionary(words.type):  # both of one dictionary
        names = words.dictionary
        own, others = (np.asarray(v.indices, dtype=np.int64) for v in (words, terms))
    else:
        coded = pa.concat_arrays([words.cast(pa.string()), terms.cast(pa.string())]).dictionary_encode()
        names, code = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        own, others = code[: len(row)], code[len(row) :]
    size = len(names)
    pair = np.flatnonzero(row[1:] == row[:-1])
    bigrams, bigram = np.unique(own[pair] * size + own[pair + 1], return_inverse=True)
    rows = np.concatenate([row, concept_row, row[pair]])
    feature = np.concatenate([own, others, size + bigram])
    tf = np.repeat([vocab.TOKEN_WEIGHT, vocab.CONCEPT_WEIGHT, vocab.BIGRAM_WEIGHT], [len(own), len(others), len(pair)])
    first, second = (names.take(pa.array(n)) for n in (bigrams // max(size, 1), bigrams % max(size, 1)))
    spelled = pa.concat_arrays([names, pc.binary_join_element_wise(first, second, "_").cast(pa.string())])
    if pc.any(pc.match_substring(names, "_")).as_py():
        # a bigram may be spelled like a token, or like another one: one feature then
        coded = spelled.dictionary_encode()
        feature, spelled = np.asarray(coded.indices, dtype=np.int64)[feature], coded.dictionary
    return *_summed(rows, feature, tf), spelled


def _sparse_vectors(tokens: pa.ListArray, concepts: pa.ListArray, dims: int) -> tuple[pa.Array, pa.Array]:
    rows, feature, tf, names = _counted(tokens, concepts)
    hashed = md5_heads(names)
    weight = np.where(tf < 1, tf, 1 + np.log(np.maximum(tf, 1)))
    weight *= np.where(hashed >= 1 << 31, -1.0, 1.0)[feature]
    bucket = (hashed % dims)[feature]
    if len(tokens) * dims <= DENSE_CELLS:
        cells = np.bincount(rows * dims + bucket, weight, minlength=len(tokens) * dims)
        at = np.flatnonzero(cells)
        rows, bucket, weight = at // dims, at % dims, cells[at]
    else:
        rows, bucket, weight = _summed(rows, bucket, weight)
        keep = weight != 0
        rows, bucket, weight = rows[keep], bucket[keep], weight[keep]
    norm = np.sqrt(np.bincount(rows, weight * weight, minlength=len(tokens)))
    ends, value = offsets(rows, len(tokens)), weight / norm[rows]
    return pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value))


def _summed(rows: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values added up for each (row, key), in that order."""
    span = int(keys.max(initial=0)) + 1
    one = len(rows) and keys.min() >= 0 and (int(rows.max()) + 1) * span < 1 << 62
    order = np.argsort(rows * span + keys, kind="stable") if one else np.lexsort((keys, rows))
    rows, keys, values = rows[order], keys[order], values[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))) if len(rows) else order
    return rows[first], keys[first], np.add.reduceat(values, first) if len(first) else values


def to_dense(idx, val, dims: int = vocab.DIMENSIONS):
    """Dense array<double> of a sparse vector."""
    table = F.map_from_arrays(idx, val)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0.0))
    )


def embed_with(
    df: DataFrame,
    fn: Callable[[list[str]], list],
    text_col: str = "text",
    out_col: str = "embedding",
    batch: int = vocab.EMBED_BATCH,
) -> DataFrame:
    """Pluggable slot: `fn` maps a list of texts to equally many vectors."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out_col}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, vectors = pdf[text_col].tolist(), []
            for low in range(0, len(texts), batch):
                part = fn(texts[low : low + batch])
                if len(part) != len(texts[low : low + batch]):
                    raise ValueError("embedder returned a different number of vectors")
                vectors.extend(np.asarray(v, dtype=np.float32) for v in part)
            yield pdf.assign(**{out_col: vectors})

    return df.mapInPandas(run, schema)


def choose_embedder(remote: DataFrame, local: DataFrame, chunks: DataFrame, mode: str = "auto") -> DataFrame:
    """All vectors from one space: (document_id, embedding, provider).

    auto takes the remote set when it covers every chunk, else the local set;
    the two are never mixed.  Explicit modes take what they name.
    """
    remote_rows = remote.where(F.col("embedding").isNotNull()).select("document_id", "embedding")
    local_rows = local.select("document_id", "embedding")
    tag = lambda df, name: df.withColumn("provider", F.lit(name))
    if mode == "local":
        return tag(local_rows, "local")
    if mode != "auto":
        return tag(remote_rows, mode)
    gaps = (
        chunks.select("document_id")
        .join(remote_rows.select("document_id"), "document_id", "left_anti")
        .agg(F.count("*").alias("missing"))
    )
    # one row, joined on a constant key so both branches stay ordinary equi-joins
    verdict = F.broadcast(gaps.select((F.col("missing") == 0).alias("complete")))
    keyed = tag(remote_rows, "remote").withColumn("complete", F.lit(True)).unionByName(
        tag(local_rows, "local").withColumn("complete", F.lit(False))
    )
    return keyed.join(verdict, "complete", "left_semi").drop("complete")


def index_build(listings: DataFrame, max_chars: int = vocab.CHUNK_MAX_CHARS, dims: int = vocab.DIMENSIONS) -> DataFrame:
    """Chunks with their vectors: the rows of one index version.  One shuffle, of the listings."""
    from hybridq.operators.documents import chunk_listings

    return with_vectors(chunk_listings(listings.repartition("id"), max_chars), "text", dims)


def document_index(documents: DataFrame, max_chars: int = vocab.CHUNK_MAX_CHARS, dims: int = vocab.DIMENSIONS) -> DataFrame:
    """The same for free prose (doc_id, text)."""
    from hybridq.operators.documents import chunk_documents

    return with_vectors(chunk_documents(documents.repartition("doc_id"), max_chars), "text", dims)


def index_manifest(index: DataFrame, provider: str, model: str, dims: int, dataset_hash, indexed_at) -> DataFrame:
    """One row describing an index; `dataset_hash` and `indexed_at` are Columns or values."""
    as_col = lambda v: v if hasattr(v, "alias") else F.lit(v)
    return index.agg(
        F.countDistinct("job_id").alias("job_count"), F.count("*").alias("chunk_count")
    ).select(
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit(dims).alias("dimensions"),
        as_col(dataset_hash).alias("dataset_hash"),
        "job_count",
        "chunk_count",
        as_col(indexed_at).alias("indexed_at"),
    )


def index_status(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: indexed flag, counts, provider, model, dimensions, time."""
    counts = index.agg(F.count("*").alias("chunks")).withColumn("_one", F.lit(1))
    header = manifest.withColumn("_one", F.lit(1))
    c = F.col
    return counts.join(F.broadcast(header), "_one", "left").select(
        (c("provider").isNotNull() & (c("chunks") > 0)).alias("indexed"),
        F.coalesce(c("job_count"), F.lit(0)).alias("job_count"),
        c("chunks").alias("chunk_count"),
        "provider",
        "model",
        F.coalesce(c("dimensions"), F.lit(0)).alias("dimensions"),
        c("indexed_at").cast("string").alias("indexed_at"),
    )


def blank(c):
    return c.isNull() | (strip(c) == "")
