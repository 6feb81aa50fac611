"""SentencePiece encoding and decoding by matching all pieces in a suffix array.

Encoding a batch: the distinct words of its texts that the worker has not met yet (a word is a
run of spaces with the letters behind it; no piece goes across) are concatenated and indexed by a suffix
array.  Every piece finds its range of occurrences by binary search, all pieces at once.  The
occurrences are edges of a lattice; sorted by position, they are relaxed from left to right,
all words in step.

The models are byte-pair merges, so the path wanted isn't the one of the best sum of
scores but the one that merging leads to.  It is the only path on which every two neighbouring
pieces stay apart when they are merged together; so a place keeps the one piece that ends there and is
compatible with the piece before it.  Characters without a piece become byte pieces.

Decoding joins piece bytes by table lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from hybridq.llm.arrow import by_bytes, slices, spans, text_bytes
from hybridq.llm.suffix_array import suffix_array
from hybridq.llm.tokens import WordStore, each_cell

SPACE = "▁"
CACHED = 1_200_000
#: Bytes of words indexed together.
INDEXED = 1 << 19
#: Pairs of pieces whose compatibility is remembered.
PAIRS = 800_000
DDL = "doc_id long, ids array<int>"


class Pieces:
    """A byte-pair SentencePiece model with byte fallback and identity normalisation; `path` is its file."""

    def __init__(self, path: str, cached: int = CACHED):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("needs a byte-pair model with byte fallback and without normalisation")
        self.prefix = spec.add_dummy_prefix
        kinds = [p.type for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {i: p.score for i, p in enumerate(proto.pieces)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        decoded = [
            bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() if k == 1 else b"" for t, k in zip(self.text, kinds)
        ]
        self.table = slices(np.frombuffer(b"".join(decoded), np.uint8), np.cumsum([0, *map(len, decoded[:-1])]))
        self.of_byte = np.zeros(256, dtype=np.int32)
        for b, i in self.byte.items():
            self.of_byte[b] = i
        self.plain = bytes(b for b in range(128) if chr(b) in self.normal)
        # pieces that merging their own letters gives back, by their bytes
        own = [(t.encode(), i) for t, i in self.normal.items() if self.merge(t) == [i]]
        own.sort()
        self.ids = np.array([i for _, i in own], dtype=np.int64)
        self.keys = [t for t, _ in own]
        self.apart: dict[int, bool] = {}
        self.store = WordStore(cached, np.int32)

    # merging: defines which neighbours stay apart
    def merge(self, text: str) -> list[int]:
        """Piece ids of a short text by merging, highest score and leftmost first; -1 for a letter without piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.normal.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.normal.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays apart when merged together."""
        if len(self.apart) > PAIRS:
            self.apart.clear()
        pairs, at = np.unique(left * len(self.text) + right, return_inverse=True)
        out = np.empty(len(pairs), dtype=bool)
        for k, code in enumerate(pairs.tolist()):
            known = self.apart.get(code)
            if known is None:
                a, b = divmod(code, len(self.text))
                known = self.apart[code] = self.merge(self.text[a] + self.text[b]) == [a, b]
            out[k] = known
        return out[at]

    def lattice(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (UTF-8, spaces as the space letter)."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.array([len(w) for w in words], dtype=np.int64)
        # bytes are symbols from 2 on; 1 ends a word, 0 the index
        s = np.ones(len(data) + len(words) + 1, dtype=np.int64)
        s[-1] = 0
        start = np.cumsum(size + 1) - size - 1
        s[spans(start, size)] = data.astype(np.int64) + 2
        low, high = self._ranges(s, suffix_array(s, 258))
        sa = self._sa
        hits = np.flatnonzero(high > low)
        width = np.array([len(self.keys[k]) for k in hits.tolist()], dtype=np.int64)
        times = (high - low)[hits]
        begin = sa[spans(low[hits], times)]
        piece, width = np.repeat(self.ids[hits], times), np.repeat(width, times)
        word = np.searchsorted(start, begin, side="right") - 1
        return self._relax(words, start, size, word, begin, width, piece)

    def _ranges(self, s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that start with each piece, by binary search of all pieces together."""
        self._sa = sa
        width = max(map(len, self.keys))
        table = np.zeros((len(self.keys), width + 1), dtype=np.int64)
        for k, t in enumerate(self.keys):
            table[k, : len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 2
        length = np.array([len(t) for t in self.keys])
        padded = np.concatenate([s, np.zeros(width + 1, dtype=np.int64)])

        def search(after: bool) -> np.ndarray:
            a, b = np.zeros(len(table), dtype=np.int64), np.full(len(table), len(sa), dtype=np.int64)
            while (a < b).any():
                mid = (a + b) // 2
                at = sa[np.minimum(mid, len(sa) - 1)]
                order = np.zeros(len(table), dtype=np.int8)  # sign of suffix less piece
                for k in range(width):
                    open_ = np.flatnonzero((order == 0) & (length > k))
                    if not len(open_):
                        break
                    x, y = padded[at[open_] + k], table[open_, k]
                    order[open_] = np.sign(x - y)
                right = (order < 0) | (after & (order == 0))
                going = a < b
                a = np.where(going & right, mid + 1, a)
                b = np.where(going & ~right, mid, b)
            return a

        return search(False), search(True)

    def _relax(self, words, start, size, word, begin, width, piece) -> list[np.ndarray]:
        end = begin + width - start[word]
        order = np.lexsort((begin, end))
        word, begin, piece, end = word[order], begin[order] - start[word[order]], piece[order], end[order]
        # last[p]: the piece that ends at p on the path; places are counted over all words, one more than bytes
        base = np.cumsum(size + 1) - size - 1
        last = np.full(int(size.sum()) + len(words), -1, dtype=np.int64)
        from_ = np.full(len(last), -1, dtype=np.int64)
        last[base] = -2
        letters = self._letters(words, base)
        steps = np.searchsorted(end, np.arange(int(end.max(initial=0)) + 2))
        for e in range(1, int(size.max(initial=0)) + 1):
            if e < len(steps) - 1:
                edge = slice(steps[e], steps[e + 1])
                at, w, p, b = base[word[edge]] + begin[edge], word[edge], piece[edge], begin[edge]
                before = last[at]
                fine = before != -1
                check = np.flatnonzero(fine & (before >= 0))
                fine[check] = self.compatible(before[check], p[check])
                to = base[w[fine]] + e
                last[to], from_[to] = p[fine], at[fine]
            if e in letters:  # letters without a piece: reached from any place, and any piece may follow
                at, to = letters[e]
                open_ = last[at] != -1
                last[to[open_]], from_[to[open_]] = -3, at[open_]
        return [self._path(w, b, last, from_) for w, b in zip(words, base.tolist())]

    def _letters(self, words: list[bytes], base: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Letters without a piece by the offset of their end: (places before, places after)."""
        out: dict[int, list] = {}
        space = SPACE.encode()
        for w, b in zip(words, base.tolist()):
            if not w.replace(space, b"").translate(None, self.plain):
                continue  # nothing but spaces and ASCII letters that are pieces
            text = w.decode("utf-8", "replace")
            if any(c not in self.normal for c in set(text)):
                at = 0
                for c in text:
                    n = len(c.encode())
                    if c not in self.normal:
                        out.setdefault(at + n, []).append((b + at, b + at + n))
                    at += n
        return {e: tuple(np.array(x) for x in zip(*v)) for e, v in out.items()}

    def _path(self, word: bytes, base: int, last: np.ndarray, from_: np.ndarray) -> np.ndarray:
        at, out = base + len(word), []
        while at > base:
            piece, before = int(last[at]), int(from_[at])
            if piece == -3:
                out += self.of_byte[np.frombuffer(word[before - base : at - base], np.uint8)][::-1].tolist()
            elif before < 0:
                raise ValueError(f"no path through {word!r}")
            else:
                out.append(piece)
            at = before
        return np.array(out[::-1], dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        letter = SPACE.encode()
        data, offsets = text_bytes(texts)
        raw, at = data.tobytes(), offsets.tolist()
        whole = [raw[a:b] for a, b in zip(at, at[1:])]
        whole = [((b" " if self.prefix else b"") + t).replace(b" ", letter) if t else b"" for t in whole]
        size = np.array([len(t) for t in whole], dtype=np.int64)
        data = np.frombuffer(b"".join(whole), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum(size)])
        # a word starts where a text starts or a space follows a letter
        is_space = np.zeros(len(data) + 3, dtype=bool)
        if len(data) >= 3:
            is_space[: len(data) - 2] = (data[:-2] == letter[0]) & (data[1:-1] == letter[1]) & (data[2:] == letter[2])
        opens = is_space[: len(data)].copy()
        opens[3:] &= ~is_space[: len(data) - 3] if len(data) >= 3 else opens[3:]
        opens[offsets[:-1][size > 0]] = True
        begin = np.flatnonzero(opens)
        coded = slices(data, begin).dictionary_encode()
        at, count = self.store.lookup(each_cell(coded.dictionary), self._learn)
        codes = np.asarray(coded.indices, dtype=np.int64)
        ids = self.store.flat[spans(at[codes], count[codes])]
        total = np.concatenate([[0], np.cumsum(count[codes])])
        return ids, np.diff(total[np.searchsorted(begin, offsets)])

    def _learn(self, words: list[bytes]) -> None:
        size, low = np.cumsum([len(w) for w in words]), 0
        while low < len(words):
            done = size[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(size, done + INDEXED, side="right")))
            found = self.lattice(words[low:high])
            self.store.add(words[low:high], np.array([len(x) for x in found]), np.concatenate(found))
            low = high

    def decode_all(self, cells: pa.ListArray) -> list[str]:
        """The texts of lists of ids, by table lookup."""
        counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(cells), 0), dtype=np.int64)
        data, at = text_bytes(self.table.take(cells.flatten()))
        cuts = at[np.concatenate([[0], np.cumsum(counts)])].tolist()
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) for every row of `docs` (doc_id, text); `path` is the model's file.

    With `decode` the text of the ids comes too, as `decoded`.  Null and empty texts have no ids; repeated
    rows give repeated rows; other columns don't matter; an empty table gives none.  No
    shuffle; a worker remembers CACHED words at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in by_bytes(batches, "text"):
            ids, counts = model.encode(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            cells = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            more = [pa.array(model.decode_all(cells), pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), cells, *more], ["doc_id", "ids", "decoded"][: 2 + decode])

    return docs.select("doc_id", "text").mapInArrow(run, DDL + (", decoded string" if decode else ""))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (..., ids) with `decoded`, the text of the ids; null ids give an empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = model.decode_all(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded string")
