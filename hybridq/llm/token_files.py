"""Token ids as binary blocks: ids ranked by corpus frequency, byte-aligned, control bytes apart.

An id is replaced by its frequency rank, so common ids need one byte.  Each group of four
values has one control byte with four two-bit lengths; control and data bytes are kept in
two separate streams.  Decoding looks the four lengths up in a 256-row table and gathers the
data bytes with numpy, without a loop over values.

Files: a table of blocks (up to BLOCK_DOCS documents each, ascending doc_id) and a table
with the rank of every id.  Blocks are Parquet rows, because executors can only reach a
shared store through Spark's writers.

Plan: tokens are made once and staged; counts of ids are a partial aggregate with at most
one row per vocabulary entry; documents are coded once (about 1.3 bytes an id) and staged, in place of
their ids, because dealing rows by range reads them twice; ranges go by doc_id and place, so
that a doc_id of many rows spreads; positions come from totals per range, so no task sees all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hybridq.llm.arrow import by_bytes, slices, spans, text_bytes
from hybridq.llm.tokens import append_end, encoder
from hybridq.plans.stages import drop_stage, materialise

BLOCK_DOCS = 512
BLOCK_BYTES = 8 << 20
#: Lengths (1 to 4 bytes) of the four values of each control byte.
LENGTHS = np.stack([((np.arange(256) >> shift) & 3) + 1 for shift in (0, 2, 4, 6)], axis=1).astype(np.int64)
STAGED = "doc_id long, n_tokens long, ids binary"
CODED = "doc_id long, n_tokens long, control binary, data binary"
BLOCKS = "part long, block long, first_token long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
READ = "part long, doc_id long, at long, n_tokens long, ids_crc32 long"


def encode_values(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Several runs of unsigned 32-bit values, `counts` long each: (control bytes, start of each run's, data bytes, start of each run's)."""
    values = values.astype("<u4")
    longer = (values > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if len(values) and values.max() > limit:
            longer += values > limit
    quads = -(-counts // 4)
    first = np.cumsum(quads) - quads
    padded = np.zeros(4 * int(quads.sum()), dtype=np.uint8)
    padded[spans(4 * first, counts)] = longer
    padded = padded.reshape(-1, 4)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    width = int(longer.max(initial=0)) + 1
    raw = values.view(np.uint8).reshape(-1, 4)[:, :width]
    so_far = np.concatenate([[0], np.cumsum(longer, dtype=np.int64)])
    ends = np.cumsum(counts)
    return control, first, raw[np.arange(width) <= longer[:, None]], ends - counts + so_far[ends - counts]


def decode_values(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of several runs, each with its own control bytes; `counts` has their lengths."""
    quads = -(-counts // 4)
    slots = spans(4 * (np.cumsum(quads) - quads), counts)
    size = LENGTHS[control].reshape(-1)[slots]
    end = np.cumsum(size)
    at = end - size
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    out = padded[at]
    for k in (1, 2, 3):
        more = size > k
        out[more] |= padded[at[more] + k] << np.uint32(8 * k)
    return out


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the block table and the rank table; returns both as read back from storage.

    Null text counts as empty (the end id alone); repeated rows are written as often as they
    occur, in any order among themselves; a null doc_id sorts first; an empty table
    gives empty files.  Other columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    staged = materialise(docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, end_id), STAGED), "tokens")
    counts = staged.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row per vocabulary entry: a proven bound
    ranked = materialise(
        counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "id")).cast("long").alias("rank"), "id", "n"), "ranks"
    )
    rank_of = _table(ranked.select("id", (F.col("rank") - 1)).collect())
    coded = materialise(staged.mapInArrow(_code(rank_of), CODED), "coded")
    drop_stage(staged)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ordered = coded.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = materialise(ordered.mapInArrow(_blocks, BLOCKS), "blocks")
    drop_stage(coded)
    return blocks, ranked


def read_tokens(blocks: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the block table."""
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written range
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    id_of = _table(ranked.select(F.col("rank") - 1, "id").collect())
    found = blocks.mapInArrow(_read(id_of), READ)
    return found.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def _table(rows) -> np.ndarray:
    out = np.zeros(max((r[0] for r in rows), default=0) + 1, dtype=np.uint32)
    for key, value in rows:
        out[key] = value
    return out


def _tokenise(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in by_bytes(batches, "text"):
            ids, counts = append_end(*enc.encode(batch.column("text")), end_id)
            raw = memoryview(ids.astype("<u2") if enc.dtype == np.uint16 else ids.astype("<u4")).cast("B")
            width = np.dtype(enc.dtype).itemsize
            ends = np.cumsum(counts) * width
            parts = [bytes([width]) + bytes(raw[e - c * width : e]) for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(parts, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return run


def _ids(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, dtype="<u2" if cell[0] == 2 else "<u4", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, dtype=np.int64)
    for batch in batches:
        cells = batch.column("ids").to_pylist()
        if cells:
            part = np.bincount(np.concatenate([_ids(c) for c in cells]))
            if len(part) > len(total):
                total, part = part, total
            total[: len(part)] += part
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])


def _code(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids"):
            cells = batch.column("ids").to_pylist()
            ids = np.concatenate([_ids(c) for c in cells]) if cells else np.empty(0, dtype=np.uint16)
            control, first, data, start = encode_values(rank_of[ids], np.asarray(batch.column("n_tokens")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), slices(control, first).cast(pa.binary()), slices(data, start).cast(pa.binary())],
                ["doc_id", "n_tokens", "control", "data"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, first = TaskContext.get().partitionId(), 0, 0
    rows: list[tuple] = []
    held = 0

    def emit():
        control, data = b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)
        columns = [[part], [block], [first], [[r[0] for r in rows]], [[r[1] for r in rows]], [control], [data]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["part", "block", "first_token", "doc_ids", "n_tokens", "control", "data"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "control", "data"))):
            rows.append(row)
            held += len(row[3])
            if len(rows) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                yield emit()
                first += sum(r[1] for r in rows)
                block, rows, held = block + 1, [], 0
    if rows:
        yield emit()


def _read(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = np.asarray(row.column("n_tokens").flatten(), dtype=np.int64)
                control, data = text_bytes(row.column("control"))[0], text_bytes(row.column("data"))[0]
                raw = memoryview(id_of[decode_values(control, data, counts)].astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                at = row.column("first_token")[0].as_py() + ends - counts
                part = np.full(len(counts), row.column("part")[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), row.column("doc_ids").flatten(), pa.array(at), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return run
