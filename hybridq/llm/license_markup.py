"""License scans by template markup compiled to token automata.

A template is license wording with optional regions (`<<beginOptional>>...<<endOptional>>`)
and replaceable regions (`<<var;min=..;max=..>>` for any words, `<<var;match=..>>` for one word
that a pattern accepts).  It compiles to a nondeterministic automaton over words: a state per
position, a word or replaceable edge to the next one, an empty edge around each optional
region.  A text matches where every word outside the regions is there, exactly and in order.

Words of a batch are found with numpy and dictionary-encoded by Arrow; an automaton only
runs where one of its first words stands, so work is linear in the text and memory is
bounded by a batch.  Scanning is a narrow projection: no shuffle, whatever the keys look like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from hybridq.llm.arrow import slices, text_bytes

# Fixed values of the contract: phrases, their labels, and what a word is made of.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Templates of this method, own label each.  Wording outside the regions is mandatory.
TEMPLATES = {
    "mit-notice": "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of "
        "<<var;min=1;max=6>> and associated documentation files"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0 "
        "<<beginOptional>>the license<<endOptional>>"
    ),
    "gpl-3.0-notice": "<<var;match=[a-z]+>> is licensed under the gnu general public license <<beginOptional>>version<<endOptional>> 3",
    "gpl-or-later-notice": (
        "under the terms of the gnu general public license as published by the free software foundation "
        "either version <<var;match=[23]>> of the license or <<beginOptional>>at your option<<endOptional>> any later version"
    ),
    "cc-by-nc-notice": "licensed under <<beginOptional>>the<<endOptional>> cc by nc <<var;match=[1-4]>> <<var;match=[05]>>",
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "<<beginOptional>>subject to the limitations in the disclaimer below<<endOptional>> provided that the following conditions are met"
    ),
}

MARKUP = re.compile(r"<<(.*?)>>")
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass
class Automaton:
    """States 0 to `accept`; `words[s]` is a literal, `tests[s]` a pattern, else any word; `jumps[s]` empty edges."""

    label: str
    words: dict[int, str] = field(default_factory=dict)
    tests: dict[int, re.Pattern] = field(default_factory=dict)
    free: set[int] = field(default_factory=set)
    jumps: dict[int, list[int]] = field(default_factory=dict)
    accept: int = 0

    def closure(self, states) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.jumps.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def step(self, states: set[int], word: str) -> set[int]:
        on = {
            s + 1
            for s in states
            if s in self.free or self.words.get(s) == word or (s in self.tests and self.tests[s].fullmatch(word))
        }
        return self.closure(on)

    def first(self) -> tuple[set[str], bool]:
        """(literals that can start a match, whether another word can)."""
        start = self.closure({0})
        return {self.words[s] for s in start if s in self.words}, any(s in self.free or s in self.tests for s in start)

    def anchor(self) -> tuple[str, int, int] | None:
        """(word, smallest, largest distance from the start) of the first mandatory literal behind a replaceable start."""
        low = high = 0
        s = 0
        while s < self.accept:
            skips = [t for t in self.jumps.get(s, ()) if t > s]
            if skips:
                high += max(skips) - s
                s = max(skips)
                continue
            if s in self.words:
                return self.words[s], low, high
            low, high, s = low + 1, high + 1, s + 1
        return None

    def match(self, words: list[str], at: int) -> int:
        """End of the longest match that starts at word `at`, or -1."""
        states, end = self.closure({0}), -1
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.accept in states:
                end = i + 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    a = Automaton(label)
    state, opened, at = 0, [], 0
    for m in [*MARKUP.finditer(markup), None]:
        for word in WORD.findall(markup[at : m.start() if m else len(markup)].lower()):
            a.words[state] = word
            state += 1
        if m is None:
            break
        at, (kind, *settings) = m.end(), m.group(1).split(";")
        given = dict(s.split("=", 1) for s in settings)
        if kind == "beginOptional":
            opened.append(state)
        elif kind == "endOptional":
            a.jumps.setdefault(opened.pop(), []).append(state)
        elif kind == "var" and "match" in given:
            a.tests[state] = re.compile(given["match"])
            state += 1
        elif kind == "var":
            low, high = int(given.get("min", 1)), int(given.get("max", 1))
            for k in range(high):
                a.free.add(state + k)
                if k >= low:
                    a.jumps.setdefault(state + k, []).append(state + high)
            state += high
        else:
            raise ValueError(f"{label}: unknown markup {m.group(0)}")
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    a.accept = state
    return a


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.base = [(p.split(), label) for p, label in BASE_PHRASES.items()]
        self.automata = [compile_template(label, markup) for label, markup in templates.items()]
        self.starts: dict[str, list[tuple[Automaton, int, int]]] = {}
        for a in self.automata:
            literals, other = a.first()
            if not other:
                for word in literals:
                    self.starts.setdefault(word, []).append((a, 0, 0))
            elif (found := a.anchor()) is not None:
                self.starts.setdefault(found[0], []).append((a, found[1], found[2]))
            else:
                raise ValueError(f"{a.label}: a template needs a mandatory word")
        wanted = {p[0] for p, _ in self.base} | set(self.starts)
        self.wanted = pa.array([w.encode() for w in sorted(wanted)], pa.large_binary())
        letters = np.arange(256)
        self.part = (letters >= 0x80) | ((letters >= 0x30) & (letters <= 0x39)) | ((letters >= 0x61) & (letters <= 0x7A))
        self.lower = np.where((letters >= 0x41) & (letters <= 0x5A), letters + 32, letters).astype(np.uint8)

    def scan(self, texts: pa.Array) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
        data, offsets = text_bytes(texts)
        data = self.lower[data]
        inside = self.part[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        doc_starts = offsets[:-1][np.diff(offsets) > 0]
        opens[doc_starts] = inside[doc_starts]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        ends_at = offsets[1:][np.diff(offsets) > 0] - 1
        closes[ends_at] = inside[ends_at]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(begin, offsets)
        # one cell per word: its bytes without what stands behind it
        kept = slices(data[inside], (np.cumsum(inside) - 1)[begin] if len(begin) else begin)
        coded = kept.dictionary_encode()
        hit = np.asarray(pa.compute.is_in(coded.dictionary, value_set=self.wanted))[np.asarray(coded.indices)] if len(begin) else np.empty(0, bool)
        places = np.flatnonzero(hit)
        cuts = np.searchsorted(places, first)
        out = []
        for i in range(len(offsets) - 1):
            n = int(first[i + 1] - first[i])
            if cuts[i] == cuts[i + 1]:
                out.append((n, 0, None, None, "", "", 0.0))
            else:
                cell = data[begin[first[i]] : end[first[i + 1] - 1]].tobytes().decode("utf-8", "replace")
                out.append((n, *self._document(WORD.findall(cell), (places[cuts[i] : cuts[i + 1]] - first[i]).tolist())))
        return out

    def _document(self, words: list[str], places: list[int]) -> tuple:
        base_at, base, labels = [], set(), set()
        done: set[tuple[str, int]] = set()
        for at in places:
            for phrase, label in self.base:
                if words[at : at + len(phrase)] == phrase:
                    base_at.append(at)
                    base.add(label)
            for a, low, high in self.starts.get(words[at], ()):
                for start in range(max(0, at - high), at - low + 1):
                    if (a.label, start) not in done:
                        done.add((a.label, start))
                        if a.match(words, start) >= 0:
                            labels.add(a.label)
        score = 1.0 if labels else 0.5 if base else 0.0
        return (
            len(base_at), min(base_at, default=None), max(base_at, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
        )


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text) with its license places and labels.

    Base phrases are counted at all places; template labels are added to theirs.  `score` is 1 where
    a whole template matches, 0.5 for base phrases alone, else 0.  Null and empty texts have no
    words, no places (null first and last word) and empty labels.  Other columns don't matter;
    repeated rows give repeated rows; an empty table gives none.
    """
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            columns = list(zip(*scanner.scan(batch.column("text")))) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DDL)
