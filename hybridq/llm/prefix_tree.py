"""Jaccard links within a bounded group of sets, by a prefix tree.

Tokens are ordered by their frequency in the group, most frequent first; sets become
ordered sequences in a path-compressed tree, so what many sets share lies on one path.  A probe walks
the tree once: the overlap with a path is computed once for all sets below it, and a
subtree is left when the overlap so far plus the smaller of the two remaining lengths can't
reach the threshold for any set in it.

Wanted are components, not all links: a subtree whose sets are already connected with
each other and with the probe is skipped.
"""

from __future__ import annotations

import numpy as np


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class _Node:
    __slots__ = ("low", "high", "depth", "children", "least", "longest", "whole")

    def __init__(self, low: int, depth: int):
        self.low, self.depth, self.children, self.whole = low, depth, [], False


def group_links(sets: list[np.ndarray], percent: int = 75) -> list[tuple[int, int]]:
    """Edges (first, other) that connect exactly the components of the sets' links.

    Two sets link when 100 * |intersection| >= percent * |union|; the sets hold distinct tokens.
    """
    n = len(sets)
    if n < 2:
        return []
    size = [len(s) for s in sets]
    flat = np.concatenate(sets)
    tokens, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), dtype=np.int32)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens), dtype=np.int32)
    ranks, alone = rank[at], counts[at] == 1
    cuts = np.cumsum(size)[:-1]
    # a token of one set overlaps with nothing: it only counts for the size
    paths = [np.sort(r[~a]) for r, a in zip(np.split(ranks, cuts), np.split(alone, cuts))]
    order = sorted(range(n), key=lambda i: paths[i].astype(">i4").tobytes())
    paths, size = [paths[i] for i in order], [size[i] for i in order]
    union = _Union(n)

    def linked(i: int, j: int, overlap: int) -> bool:
        return overlap > 0 and 100 * overlap >= percent * (size[i] + size[j] - overlap)

    inside = np.zeros(len(tokens) + 1, dtype=bool)
    common = []
    for i in range(n - 1):
        a, b = paths[i], paths[i + 1]
        m = min(len(a), len(b))
        differs = a[:m] != b[:m]
        common.append(int(differs.argmax()) if differs.any() else m)
        inside[a] = True
        if linked(i, i + 1, int(inside[b].sum())):
            union.join(i, i + 1)
        inside[a] = False
    root = _tree(paths, common)
    _finish(root, paths, size, union)

    for i in range(n):
        x = paths[i]
        inside[x] = True
        todo = [(root, 0, 0)]
        while todo:
            node, start, overlap = todo.pop()
            if node.high <= i or (node.whole and union.find(node.low) == union.find(i)):
                continue
            path = paths[node.low]
            overlap += int(np.count_nonzero(inside[path[start : node.depth]]))
            behind = len(x) - int(np.searchsorted(x, path[node.depth - 1], side="right")) if node.depth else len(x)
            most = overlap + min(behind, node.longest - node.depth)
            if (100 + percent) * most < percent * (size[i] + node.least):
                continue
            if not node.children:
                if node.low > i and linked(i, node.low, overlap):
                    union.join(i, node.low)
                continue
            todo += [(c, node.depth, overlap) for c in node.children]
            if not node.whole and all(c.whole for c in node.children):
                node.whole = len({union.find(c.low) for c in node.children}) == 1
        inside[x] = False
    return [(order[union.find(i)], order[i]) for i in range(n) if union.find(i) != i]


def _tree(paths: list[np.ndarray], common: list[int]) -> _Node:
    """The compressed tree of sorted paths; `common` has the shared lengths of neighbours."""
    root = _Node(0, 0)
    stack = [root]
    for i, path in enumerate(paths):
        shared = common[i - 1] if i else 0
        last = None
        while stack[-1].depth > shared or not (stack[-1].children or stack[-1] is root):
            last = stack.pop()
        if last is not None and stack[-1].depth < shared:  # a new fork on the way to the last path
            fork = _Node(last.low, shared)
            fork.children.append(last)
            stack[-1].children[-1] = fork
            stack.append(fork)
        leaf = _Node(i, len(path))
        stack[-1].children.append(leaf)
        stack.append(leaf)
    return root


def _finish(root: _Node, paths, size, union: _Union) -> None:
    """Bounds of each subtree, and whether its sets are connected already."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        if not node.children:
            node.high, node.least, node.longest, node.whole = node.low + 1, size[node.low], len(paths[node.low]), True
        else:
            node.high = max(c.high for c in node.children)
            node.least = min(c.least for c in node.children)
            node.longest = max(c.longest for c in node.children)
            node.whole = all(c.whole for c in node.children) and len({union.find(c.low) for c in node.children}) == 1
