"""Tokenizer and token features, as array expressions inside one projection."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from hybridq import vocab
from hybridq.functions.strings import let, look_up, string_map, strings


def normalise_phrases(c: Column, phrases: dict = vocab.PHRASES) -> Column:
    """Lower-case and fuse known phrases into one token, longest phrase first."""
    text = F.lower(F.coalesce(c, F.lit("")))
    for phrase in sorted(phrases, key=len, reverse=True):
        text = F.replace(text, F.lit(phrase), F.lit(f" {phrases[phrase]} "))
    return text


def tokenize(
    c: Column,
    phrases: dict = vocab.PHRASES,
    synonyms: dict = vocab.SYNONYMS,
    stopwords: list = vocab.STOPWORDS,
) -> Column:
    """array<string>: split, drop stop words, map synonyms, then drop a plural s."""
    words = F.filter(
        F.split(normalise_phrases(c, phrases), "[^a-z0-9+#]+"), lambda w: (w != "") & ~w.isin(stopwords)
    )
    table = string_map(synonyms)
    mapped = F.transform(words, lambda w: F.coalesce(look_up(table, w), w))
    plural = lambda w: (F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(mapped, lambda w: F.when(plural(w), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))


#: Bytes of text whose words are held at once.
TEXT_BYTES = 1 << 20
_PLAIN = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789+#" or b == 0xFF else 0x20 for b in range(256))


class Tokenizer:
    """`tokenize` and `concept_terms` for Arrow arrays inside a task: a word's token is made when it is first seen.

    The words of a task are remembered, and forgotten between two arrays once there are more than `known`."""

    def __init__(self, known: int = 1 << 18):
        self.most = known
        self.phrases = [(p.encode(), f" {vocab.PHRASES[p]} ".encode()) for p in sorted(vocab.PHRASES, key=len, reverse=True)]
        self.forget()

    def forget(self) -> None:
        numbers: dict[str, int] = {}
        self.names: list[str] = []
        names, stopwords = self.names, {w.encode() for w in vocab.STOPWORDS}

        def number(token: str) -> int:
            if token not in numbers:
                numbers[token] = len(names)
                names.append(token)
            return numbers[token]

        class Codes(dict):
            def __missing__(self, word: bytes) -> int:
                code = -1
                if word not in stopwords:
                    token = word.decode()
                    token = vocab.SYNONYMS.get(token, token)
                    code = number(token[:-1] if len(token) > 4 and token.endswith("s") and not token.endswith("ss") else token)
                self[word] = code
                return code

        self.codes = Codes()
        self.concepts = {number(c): [number(t) for t in terms] for c, terms in vocab.CONCEPTS.items()}

    def words(self, texts: pa.Array) -> Iterator[list[list[bytes]]]:
        """The words of each text, about TEXT_BYTES of texts at a time."""
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT_BYTES, side="right")))
            part = [t or b"" for t in texts.slice(low, high - low).cast(pa.large_binary()).to_pylist()]
            # 0xFF stands between texts: no byte of UTF-8
            joined = b"\xff".join(part)
            if joined.count(b"\xff") >= len(part):
                joined = b"\xff".join(t.replace(b"\xff", b" ") for t in part)
            # the two letters beyond ASCII whose lower case holds a letter of ASCII
            joined = joined.lower().replace("\u0130".encode(), "i\u0307".encode()).replace("\u212a".encode(), b"k")
            for phrase, fused in self.phrases:
                joined = joined.replace(phrase, fused)
            yield [text.split() for text in joined.translate(_PLAIN).split(b"\xff")]
            low = high

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of each token; codes count the `names`."""
        if len(self.names) > self.most:
            self.forget()
        code, lengths, parts = self.codes.__getitem__, [], []
        for rows in self.words(texts):
            lengths += map(len, rows)
            parts.append(np.fromiter(map(code, chain.from_iterable(rows)), dtype=np.int64))
        codes = np.concatenate([*parts, np.zeros(0, dtype=np.int64)])
        row = np.repeat(np.arange(len(texts)), np.array(lengths, dtype=np.int64))
        return row[codes >= 0], codes[codes >= 0]

    def lists(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """(tokens, concept terms) of each text, as lists of strings coded by one dictionary."""
        row, codes = self.coded(texts)
        naming = np.flatnonzero(np.isin(codes, list(self.concepts)))
        terms = [self.concepts[c] for c in codes[naming].tolist()]
        concept_row = np.repeat(row[naming], np.array([len(t) for t in terms], dtype=np.int64))
        concept = np.array([t for each in terms for t in each], dtype=np.int64)
        used, at = np.unique(np.concatenate([codes, concept]), return_inverse=True)
        dictionary = pa.array([self.names[c] for c in used.tolist()], pa.string())
        at = at.astype(np.int32)
        return tuple(
            pa.ListArray.from_arrays(offsets(r, len(texts)), pa.DictionaryArray.from_arrays(v, dictionary))
            for r, v in ((row, at[: len(row)]), (concept_row, at[len(row) :]))
        )


def offsets(row: np.ndarray, size: int) -> pa.Array:
    """Offsets of lists whose elements stand in these rows."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))]).astype(np.int32))


def concept_terms(tokens: Column, concepts: dict = vocab.CONCEPTS, stem_concepts: bool = False) -> Column:
    """Concrete terms of every token that names a concept (without the token itself)."""
    if stem_concepts:
        stem = lambda w: w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w
        concepts = {stem(k): [stem(x) for x in v] for k, v in concepts.items()}
    table = F.create_map(*[x for k, v in concepts.items() for x in (F.lit(k), strings(v))])
    named = F.filter(tokens, lambda t: t.isin(list(concepts)))
    return F.flatten(F.transform(named, lambda t: look_up(table, t)))


def expand_concepts(tokens: Column, concepts: dict = vocab.CONCEPTS, stem_concepts: bool = False) -> Column:
    """Each token followed by the concrete terms of its concept."""
    return F.flatten(
        F.transform(tokens, lambda t: F.concat(F.array(t), concept_terms(F.array(t), concepts, stem_concepts)))
    )


def token_bigrams(tokens: Column) -> Column:
    # the tokens are asked for several times, and made once
    def pairs(t: Column) -> Column:
        n = F.size(t)
        return F.when(n < 2, strings([])).otherwise(
            F.zip_with(
                F.slice(t, F.lit(1), n - 1),
                F.slice(t, F.lit(2), n - 1),
                lambda a, b: F.concat(a, F.lit("_"), b),
            )
        )

    return let(tokens, pairs)


def feature_hash(feature: Column) -> Column:
    """The first 32 bits of the md5 of a feature, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_bucket(h: Column, dims: int = vocab.DIMENSIONS) -> Column:
    return (h % dims).cast("int")


def hash_sign(h: Column) -> Column:
    """-1 when the top bit of the 32-bit hash is set."""
    return F.when(h >= F.lit(2**31), -1.0).otherwise(1.0)
