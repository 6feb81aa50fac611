"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed to context-size tiers by their length in tokens.  Each tier is packed
into windows of its own size, longest documents first; what is left open in a window is filled
from the shorter tiers, and the last gap is closed with a cut piece.  A window that is
full holds exactly a tier's size, which is a power of two, so it needs no padding; only
the last window of a packing group may have to be padded.  Full windows are then dealt to
step groups of equal token count.

Tokens never leave the task that made them: a packing group is a run of documents of one
input partition with about `group_tokens` tokens, planned and emitted before the next one
is read.  There is no shuffle, memory is bounded by the group and one Arrow batch, and a
lost task is simply run again.  A group's size doesn't depend on keys, so hot sources or
copies don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hybridq.llm.arrow import by_bytes
from hybridq.llm.tokens import append_end, encoder

TIERS = (256, 512, 1024, 2048, 4096)
GROUP_TOKENS = 4_000_000
STEP_TOKENS = 16 * 4096
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_id", pa.int64())]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


def plan(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """[(window size, [(document, start, length), ...]), ...] covering every token once.

    Empty documents (length 0) get no piece.  Ties are placed in document order.
    """
    top = tiers[-1]
    windows: list[tuple[int, list]] = []
    shelves: list[list] = [[] for _ in tiers]  # of each tier: (length, -document, start), ascending
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= top:
            windows.append((top, [(doc, start, top)]))
            start += top
        if n > start:
            shelves[_tier(n - start, tiers)].append((n - start, -doc, start))
    for shelf in shelves:
        shelf.sort()
    for level in range(len(tiers) - 1, -1, -1):
        size = tiers[level]
        while shelves[level]:
            n, doc, start = shelves[level].pop()
            pieces, gap = [(-doc, start, n)], size - n
            while gap:
                donor = _largest(shelves, level, gap)
                if donor is None:
                    break
                rank, at, whole = donor
                n, doc, start = shelves[rank].pop(at)
                take = n if whole else gap
                pieces.append((-doc, start, take))
                gap -= take
                if take < n:
                    rest = (n - take, doc, start + take)
                    insort(shelves[_tier(rest[0], tiers)], rest)
            windows.append((size, pieces))
    return windows


def _tier(n: int, tiers) -> int:
    return next(i for i, size in enumerate(tiers) if n <= size)


def _largest(shelves, level: int, gap: int):
    """The longest document of this tier or a shorter one that fits the gap, else one to cut."""
    for rank in range(level, -1, -1):
        at = bisect_right(shelves[rank], (gap, 1, 0)) - 1
        if at >= 0:
            return rank, at, True
    for rank in range(level + 1):
        if shelves[rank]:
            return rank, len(shelves[rank]) - 1, False
    return None


def step_groups(windows, step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each window: filled longest first, so that all steps but the last hold `step_tokens`.

    Sizes are powers of two that divide the step, so a step in which longer windows leave
    room is closed exactly by shorter ones.
    """
    order = sorted(range(len(windows)), key=lambda i: -windows[i][0])
    steps, used = [0] * len(windows), 0
    for i in order:
        steps[i] = used // step_tokens
        used += windows[i][0]
    return steps


def pack(docs: DataFrame, tokenizer: str, end_id: int, group_tokens: int = GROUP_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of every row of `docs` (doc_id, text; other columns are ignored).

    Null text counts as empty and gives the end id alone.  Repeated rows are packed as
    often as they occur.  A null doc_id stays null.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []
        tokens = 0
        enc = encoder(tokenizer)

        def emit():
            nonlocal made
            keys = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            counts = np.concatenate([h[2] for h in held])
            out = _pieces(keys, ids, counts, base + made, step_tokens)
            made += out[1]
            return out[0]

        for batch in by_bytes(batches, "text"):
            ids, counts = append_end(*enc.encode(batch.column("text")), end_id)
            at = np.concatenate([[0], np.cumsum(counts)])
            low = 0
            while low < len(counts):  # a batch may hold more than a group
                high = max(low + 1, int(np.searchsorted(at, at[low] + group_tokens - tokens, side="right")) - 1)
                held.append((batch.column("doc_id")[low:high].cast(pa.int64()), ids[at[low] : at[high]], counts[low:high]))
                tokens += int(at[high] - at[low])
                low = high
                if tokens >= group_tokens or low < len(counts):
                    yield emit()
                    held, tokens = [], 0
        if held:
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def _pieces(keys: pa.Array, ids: np.ndarray, counts: np.ndarray, first: int, step_tokens: int) -> tuple[pa.RecordBatch, int]:
    begin = np.cumsum(counts) - counts
    raw = memoryview(ids.astype("<u4")).cast("B")
    windows = plan(counts.tolist())
    steps = step_groups(windows, step_tokens)
    rows = []
    for seq, (size, pieces) in enumerate(windows):
        offset = 0
        for doc, start, length in pieces:
            low = 4 * int(begin[doc] + start)
            rows.append((doc, start, length, zlib.crc32(raw[low : low + 4 * length]), seq, offset, size, steps[seq]))
            offset += length
    doc, start, length, crc, seq, offset, size, step = (np.array(c, dtype=np.int64) for c in zip(*rows))
    columns = [keys.take(pa.array(doc)), start, length, crc, counts[doc], first + seq, offset, size.astype(np.int32), first + step]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=PIECES), len(windows)
