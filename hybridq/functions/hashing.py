"""MD5 of many short texts at once, as feature hashing needs it."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts hashed at once, and bytes a text may have in one block of MD5.
ROWS = 4096
BLOCK_BYTES = 55

_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_TURN = [s for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turns * 4]


def md5_heads(texts: pa.Array) -> np.ndarray:
    """The first 32 bits of the MD5 of each text (not null), as int64."""
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    out = np.empty(len(texts), dtype=np.int64)
    for low in range(0, len(texts), ROWS):
        part = texts.slice(low, ROWS)
        sizes = size[low : low + ROWS]
        short = np.flatnonzero(sizes <= BLOCK_BYTES)
        out[low + short] = _one_block(part.take(pa.array(short)), sizes[short])
        for i in np.flatnonzero(sizes > BLOCK_BYTES).tolist():
            out[low + i] = int.from_bytes(hashlib.md5(part[i].as_py().encode()).digest()[:4], "big")
    return out


def _one_block(texts: pa.Array, sizes: np.ndarray) -> np.ndarray:
    n = len(texts)
    block = np.zeros((n, 64), dtype=np.uint8)
    ends = np.cumsum(sizes)
    # `take` has made an array of its own, whose bytes stand without gaps from its first offset on
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, dtype=np.uint8)
    block.reshape(-1)[np.arange(len(data)) + np.repeat(np.arange(n) * 64 - (ends - sizes), sizes)] = data
    block[np.arange(n), sizes] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = sizes * 8
    a, b, c, d = (np.full(n, v) for v in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += words[g]
        f += _K[i]
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=turned)
        np.left_shift(f, np.uint32(_TURN[i]), out=f)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + _START[0]).byteswap().astype(np.int64)
