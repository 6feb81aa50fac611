"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

The pre-tokenizers used here never let a token run from a word into the white space
that follows it.  A text may therefore be cut in front of every run of white space;
the ids of the text are the ids of its cuts in order.  Arrow finds the distinct cuts of
a batch, the library encodes those that the worker has not met yet, and numpy puts the
ids together.  Texts with unusual white space are not cut at all.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from hybridq.llm.arrow import slices, spans, text_bytes

ODD_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
JOINED = 300
LONGEST = 256
#: A word of Latin letters and the marks after it: one or two pre-tokens, untouched by NFC.
LATIN = re.compile("^ [A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]+)?$")
CACHED = 700_000


class WordStore:
    """Ids of words that a worker remembers, in one flat array; forgets all when `cached` words would be exceeded."""

    def __init__(self, cached: int, dtype):
        self.cached, self.dtype = cached, dtype
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, dtype=self.dtype)
        self.begin = np.empty(1 << 14, dtype=np.int64)
        self.count = np.empty(1 << 14, dtype=np.int64)
        self.used = 0

    def lookup(self, words: list[bytes], learn) -> tuple[np.ndarray, np.ndarray]:
        """(begin, count) in `flat` of each word; `learn` adds those that are new."""
        missing = [w for w in words if w not in self.known]
        if missing and len(self.known) + len(missing) > self.cached:
            self.clear()
            missing = words
        if missing:
            learn(missing)
        at = np.fromiter((self.known[w] for w in words), dtype=np.int64, count=len(words))
        return self.begin[at], self.count[at]

    def add(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(words)
        if last > len(self.begin):
            self.begin = np.resize(self.begin, max(last, 2 * len(self.begin)))
            self.count = np.resize(self.count, len(self.begin))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first:last] = self.used + np.cumsum(counts) - counts
        self.count[first:last] = counts
        self.used += len(ids)
        for i, w in enumerate(words, first):
            self.known[w] = i


class PieceEncoder:
    """`path` is a tokenizer file; `cached` bounds the words that a worker remembers."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        # without a normalizer a byte-level token has one letter for each byte
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_length = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        if self.by_length:
            self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self.width[i] = len(token)
        else:
            # word-end tokens tell where a pre-token ends
            suffix = spec["model"].get("end_of_word_suffix") or "\0"
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            for token, i in vocab.items():
                self.ends[i] = token.endswith(suffix)
        self.store = WordStore(cached, self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype) for e in found]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        data, offsets = text_bytes(texts)
        sizes = np.diff(offsets)
        space = data == 0x20
        cut = np.zeros(len(data), dtype=bool)
        if len(data):
            cut[1:] = space[1:] & (data[:-1] > 0x20)
            lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | ((data >= 0x1C) & (data <= 0x1F))
            found = ODD_SPACE.finditer(data.tobytes()) if lead.any() else ()
            odd = np.array([m.start() for m in found], dtype=np.int64)
            for i in np.unique(np.searchsorted(offsets, odd, side="right") - 1):
                cut[offsets[i] : offsets[i + 1]] = False
            cut[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        coded = slices(data, starts).dictionary_encode()
        codes = np.asarray(coded.indices, dtype=np.int64)
        begin, count = self.store.lookup(each_cell(coded.dictionary), self._learn)
        lengths = count[codes]
        ids = self.store.flat[spans(begin[codes], lengths)]
        per_piece = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(per_piece[np.searchsorted(starts, offsets)])

    def _learn(self, pieces: list[bytes]) -> None:
        joinable, alone, words = [], [], []
        for p in pieces:
            if self.by_length:
                fits = p[:1] == b" " and p[-1] > 0x20 and len(p) <= LONGEST and not ODD_SPACE.search(p)
            else:
                latin = LATIN.match(p.decode("utf-8", "replace")) if len(p) <= LONGEST else None
                fits = latin is not None
                if fits:
                    words.append(2 if latin.group(1) else 1)
            (joinable if fits else alone).append(p)
        for low in range(0, len(joinable), JOINED):
            group = joinable[low : low + JOINED]
            ids = self._ids([b"".join(group).decode("utf-8", "replace")])[0]
            if self.by_length:  # bytes so far
                so_far, want = np.cumsum(self.width[ids]), np.cumsum([len(p) for p in group])
            else:  # pre-tokens so far
                so_far, want = np.cumsum(self.ends[ids]), np.cumsum(words[low : low + JOINED])
            at = np.searchsorted(so_far, want) + 1
            if len(ids) and at[-1] == len(ids) and (so_far[at - 1] == want).all():
                self.store.add(group, np.diff(at, prepend=0), ids)
            else:
                alone += group
        if alone:
            found = self._ids([p.decode("utf-8", "replace") for p in alone])
            self.store.add(alone, np.array([len(x) for x in found]), np.concatenate(found))


def each_cell(values: pa.Array) -> list[bytes]:
    data, offsets = text_bytes(values)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def append_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end` after each text."""
    out = np.empty(len(ids) + len(counts), dtype=np.uint32)
    last = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), dtype=bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end
    return out, counts + 1
