"""A byte-level convolutional network in numpy that scores whole documents.

Bytes are embedded; learned filters of WIDTH bytes move over them in steps of STRIDE.  A
chunk is two neighbouring blocks of BLOCK positions, so chunks overlap by half and cover the whole
document.  In each chunk the filters are max-pooled and averaged and pass a hidden layer; the hidden units
are max-pooled over all chunks of the document and combined into one probability.

Text is the only input.  An empty text is one chunk of padding and gets a score like any other.
Work is linear in bytes; memory is bounded by a slice of blocks, plus 1.5 bytes a byte of the longest document
in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from hybridq.llm.arrow import text_bytes

DIMS, WIDTH, STRIDE, FILTERS, HIDDEN, BLOCK = 6, 8, 4, 24, 16, 32
BLOCK_BYTES = BLOCK * STRIDE
HALF = STRIDE * DIMS
PAD = 256
SLICE = 4096


@dataclass
class Model:
    embed: np.ndarray  # 257 x DIMS, the last row is padding and stays zero
    near: np.ndarray  # HALF x FILTERS: the first STRIDE bytes of each filter
    far: np.ndarray  # HALF x FILTERS: the other bytes
    bias: np.ndarray
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return list(self.__dict__.values())


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)

    def normal(scale, *shape):
        return (rng.normal(size=shape) * scale).astype(np.float32)

    embed = normal(0.5, 257, DIMS)
    embed[PAD] = 0
    return Model(
        embed, normal(0.3, HALF, FILTERS), normal(0.3, HALF, FILTERS), normal(0.1, FILTERS),
        normal(0.2, 2 * FILTERS, HIDDEN), np.full(HIDDEN, 0.1, np.float32), normal(0.3, HIDDEN), np.zeros(1, np.float32),
    )


def lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks x BLOCK_BYTES of byte codes, number of blocks of each document, two at least)."""
    sizes = np.diff(offsets)
    blocks = np.maximum(2, -(-sizes // BLOCK_BYTES))
    codes = np.full(int(blocks.sum()) * BLOCK_BYTES, PAD, dtype=np.int16)
    starts = (np.cumsum(blocks) - blocks) * BLOCK_BYTES
    codes[np.repeat(starts - offsets[:-1], sizes) + np.arange(len(data))] = data
    return codes.reshape(-1, BLOCK_BYTES), blocks


def convolve(m: Model, codes: np.ndarray, after: np.ndarray, last: np.ndarray):
    """(inputs, responses) at each position; `after` is the block behind, `last` marks final blocks of documents."""
    x = m.embed[codes.reshape(-1)].reshape(-1, HALF)
    both = x @ np.concatenate([m.near, m.far], axis=1)
    z = both[:, :FILTERS] + m.bias
    z[:-1] += both[1:, FILTERS:]
    ends = np.flatnonzero(last[:-1]) * BLOCK + BLOCK - 1  # the next document is not part of the window
    z[ends] -= both[ends + 1, FILTERS:]
    if not last[-1]:
        z[-1] += m.embed[after[:STRIDE]].reshape(-1) @ m.far
    return x, z.reshape(-1, BLOCK, FILTERS)


def pool_blocks(m: Model, codes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, mean) of the filters in each block, computed a slice at a time."""
    last = np.zeros(len(codes), dtype=bool)
    last[np.cumsum(blocks) - 1] = True
    top = np.empty((len(codes), FILTERS), dtype=np.float32)
    mean = np.empty_like(top)
    for low in range(0, len(codes), SLICE):
        high = min(low + SLICE, len(codes))
        _, z = convolve(m, codes[low:high], codes[high if high < len(codes) else low], last[low:high])
        np.maximum(z, 0, out=z)
        top[low:high], mean[low:high] = z.max(axis=1), z.mean(axis=1)
    return top, mean


def chunk_pairs(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each chunk, first chunk of each document)."""
    ends = np.cumsum(blocks) - 1
    first = np.ones(int(blocks.sum()), dtype=bool)
    first[ends] = False
    return np.flatnonzero(first), np.cumsum(blocks - 1) - (blocks - 1)


def score_bytes(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 1:
        return np.empty(0)
    codes, blocks = lay_out(data, offsets)
    top, mean = pool_blocks(m, codes, blocks)
    at, starts = chunk_pairs(blocks)
    features = np.concatenate([np.maximum(top[at], top[at + 1]), (mean[at] + mean[at + 1]) / 2], axis=1)
    h = np.maximum(features @ m.hidden + m.hidden_bias, 0)
    logit = np.maximum.reduceat(h, starts, axis=0).astype(np.float64) @ m.out.astype(np.float64) + float(m.out_bias[0])
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def gradients(m: Model, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    codes, blocks = lay_out(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    last = np.zeros(len(codes), dtype=bool)
    last[np.cumsum(blocks) - 1] = True
    x, z = convolve(m, codes, codes[0], last)
    r = np.maximum(z, 0)
    where = r.argmax(axis=1)
    top, mean = np.take_along_axis(r, where[:, None], 1)[:, 0], r.mean(axis=1)
    at, starts = chunk_pairs(blocks)
    features = np.concatenate([np.maximum(top[at], top[at + 1]), (mean[at] + mean[at + 1]) / 2], axis=1)
    h = np.maximum(features @ m.hidden + m.hidden_bias, 0)
    peak = np.maximum.reduceat(h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(peak @ m.out + m.out_bias[0], -30, 30)))

    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    chunks = blocks - 1
    d_h = np.where((h == np.repeat(peak, chunks, axis=0)) & (h > 0), np.repeat(d_logit[:, None] * m.out, chunks, axis=0), 0)
    d_features = d_h @ m.hidden.T
    d_top, d_mean = np.zeros_like(top), np.zeros_like(mean)
    left = top[at] >= top[at + 1]
    d_max, d_avg = d_features[:, :FILTERS], d_features[:, FILTERS:] / 2
    # a block is the left half of one chunk and the right half of another at most
    d_top[at] += d_max * left
    d_top[at + 1] += d_max * ~left
    d_mean[at] += d_avg
    d_mean[at + 1] += d_avg
    d_z = np.repeat((d_mean / BLOCK)[:, None], BLOCK, axis=1)
    np.put_along_axis(d_z, where[:, None], np.take_along_axis(d_z, where[:, None], 1) + d_top[:, None], 1)
    d_z = np.where(z > 0, d_z, 0).reshape(-1, FILTERS)
    shifted = np.zeros_like(x)
    shifted[:-1] = x[1:]
    ends = np.flatnonzero(last) * BLOCK + BLOCK - 1
    shifted[ends] = 0
    d_x = d_z @ m.near.T
    back = d_z @ m.far.T
    back[ends] = 0
    d_x[1:] += back[:-1]
    d_x = d_x.reshape(-1, DIMS)
    flat = codes.reshape(-1)
    d_embed = np.stack([np.bincount(flat, d_x[:, k], minlength=257) for k in range(DIMS)], axis=1)
    d_embed[PAD] = 0
    return [
        d_embed, x.T @ d_z, shifted.T @ d_z, d_z.sum(0), features.T @ d_h, d_h.sum(0), peak.T @ d_logit,
        np.array([d_logit.sum()]),
    ]


def train(texts: list[bytes], labels: list[int], epochs: int = 11, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> Model:
    """Adam on balanced batches; with one class or no row at all the output bias alone tells it."""
    m = new_model(seed)
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        for a in m.arrays()[4:]:
            a[:] = 0
        m.out_bias[:] = 0 if len(y) == 0 else 4 * (2 * y[0] - 1)
        return m
    rng = np.random.default_rng(seed)
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    steps = epochs * max(1, -(-len(y) // batch))
    arrays = m.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    queues: list[list[int]] = [[], []]
    for step in range(1, steps + 1):
        chosen: list[int] = []
        for kind, queue in zip(kinds, queues):
            while len(queue) < batch // 2:
                queue += rng.permutation(kind).tolist()
            chosen += queue[: batch // 2]
            del queue[: batch // 2]
        grads = gradients(m, [texts[i] for i in chosen], y[chosen])
        lr = rate * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        for a, g, u, v in zip(arrays, grads, first, second):
            u += 0.1 * (g - u)
            v += 0.002 * (g * g - v)
            a -= (lr * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    return m


def batch_scores(m: Model, texts: pa.Array) -> np.ndarray:
    """Scores of a column of texts, some MB at a time; a document is never cut."""
    data, offsets = text_bytes(texts)
    parts, low = [np.empty(0)], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (4 << 20), side="right")) - 1)
        parts.append(score_bytes(m, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
        low = high
    return np.concatenate(parts)


def scorer(m: Model):
    """A mapInArrow function that puts a score in the place of the text, the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(batch_scores(m, batch.columns[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "score"])

    return run


def keeper(m: Model, threshold: float):
    """A mapInArrow function that keeps the rows whose text reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(m, batch.column("text")) >= threshold))

    return run
