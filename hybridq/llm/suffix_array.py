"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is S-type when it is smaller than the next one, else L-type; a leftmost S-type
suffix (LMS) follows an L-type one.  LMS substrings are sorted by one induction and named; the
string of names is sorted recursively; a second induction from the sorted LMS suffixes
gives all others in linear time.

Small alphabets: a bucket is induced as whole arrays, because all that a bucket receives
from others is there when its turn comes; only runs of its own symbol need further rounds.
Large alphabets (names) have too many small buckets for that and use the plain scan.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Sorted suffixes of `s`, whose symbols are below `size` and whose last symbol 0 occurs nowhere else."""
    if len(s) == 1:
        return np.zeros(1, dtype=np.int64)
    small = _classify(s)
    is_lms = np.zeros(len(s), dtype=bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    induce = _induce_arrays if len(s) > 64 * size else _induce_scan
    roughly = induce(s, size, small, lms)
    ordered = roughly[is_lms[roughly]]
    names = _names(s, lms, ordered)
    count = int(names[-1]) + 1
    if count == len(lms):
        return induce(s, size, small, ordered)
    of = np.empty(len(s), dtype=np.int64)
    of[ordered] = names
    return induce(s, size, small, lms[suffix_array(of[lms], count)])


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type; equal neighbours take the type of the next different one."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(s[:-1] < s[1:], True)
    return small[decided]


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring in `ordered`; equal substrings share one."""
    length = np.zeros(len(s), dtype=np.int64)
    length[lms[:-1]] = np.diff(lms)
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (length[a] > 0)
    pairs = np.flatnonzero(same)
    k = 0
    while len(pairs):
        equal = s[a[pairs] + k] == s[b[pairs] + k]
        same[pairs[~equal]] = False
        pairs = pairs[equal & (length[a[pairs]] > k)]
        k += 1
    return np.append(0, np.cumsum(~same))


def _split(items: np.ndarray, symbols: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append `items` to the queues of their symbols, in order."""
    if len(items):
        order = np.argsort(symbols, kind="stable")
        items, symbols = items[order], symbols[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(items)]):
            queues[symbols[low]].append(items[low:high])


def _induce_arrays(s: np.ndarray, size: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    symbols = s.astype(np.uint16)
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _split(lms, symbols[lms], seeds)

    def sweep(buckets, own: list[list[np.ndarray]], then: list[list[np.ndarray]], wanted: bool) -> list[list[np.ndarray]]:
        """Fill the buckets' queues from their `own` ones and then from `then`, both in scanning order."""
        done: list[list[np.ndarray]] = [[] for _ in range(size)]
        for c in buckets:
            wave = np.concatenate(own[c]) if own[c] else np.empty(0, dtype=np.int64)
            while len(wave):
                done[c].append(wave)
                wave = push(wave, c, own, wanted)
            for items in then[c]:
                push(items, c, own, wanted)
        return done

    def push(items, c, queues, wanted):
        before = items[items > 0] - 1
        before = before[small[before] == wanted]
        to = symbols[before]
        self_ = to == c
        _split(before[~self_], to[~self_], queues)
        return before[self_]

    large = sweep(range(size), [[] for _ in range(size)], seeds, False)
    backwards = [[x[::-1] for x in reversed(q)] for q in large]
    own: list[list[np.ndarray]] = [[] for _ in range(size)]
    own[0].append(np.array([len(s) - 1]))
    smaller = sweep(range(size - 1, -1, -1), own, backwards, True)
    parts = []
    for c in range(size):
        parts += large[c]
        parts += [x[::-1] for x in reversed(smaller[c])]
    return np.concatenate(parts)


def _induce_scan(s: np.ndarray, size: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    text, kind = s.tolist(), small.tolist()
    sa = [-1] * n
    tail = ends.tolist()
    for p in lms[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = (ends - counts).tolist()
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not kind[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and kind[p]:
            c = text[p]
            tail[c] -= 1
            sa[tail[c]] = p
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PLCP, phi): the common prefix of each suffix with the one before it in sorted order, by text position.

    Where the symbols in front of both suffixes agree, the value is the neighbour's less one; only the
    other positions are compared, four symbols at a time.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, dtype=bool)
    both = np.flatnonzero(phi[1:] > 0) + 1
    fresh[both] = s[both - 1] != s[phi[both] - 1]
    at = np.flatnonzero(fresh & (phi >= 0))
    padded = np.concatenate([s.astype(np.uint16), np.full(4, 0xFFFF, dtype=np.uint16)])
    words = np.ndarray(n, dtype=np.uint64, buffer=padded.data, strides=(2,))
    length = np.zeros(n, dtype=np.int64)
    active, k = at, 0
    while len(active):  # the last symbol is unique, so every comparison ends inside the text
        a, b = np.minimum(active + k, n - 1), np.minimum(phi[active] + k, n - 1)
        equal = words[a] == words[b]
        stopped = active[~equal]
        rest = np.zeros(len(stopped), dtype=np.int64)
        going = np.ones(len(stopped), dtype=bool)
        for j in range(4):
            going &= padded[np.minimum(stopped + k + j, n + 3)] == padded[np.minimum(phi[stopped] + k + j, n + 3)]
            rest += going
        length[stopped] = k + rest
        active, k = active[equal], k + 4
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(length[last] - (np.arange(n) - last), 0), phi
