"""Exact scan of an item table against blocks of queries.

Every item has to meet every query of an exact nearest-neighbour search, but the pairs never have to
exist as rows.  What leaves a task is the running answer only (k rows per query, or counts), so memory is
bounded by a query block and one Arrow batch, and no item group is ever held in one task.

Two ways, with equal results:

* Up to SENT_BLOCKS blocks, each of at most QUERY_BLOCK rows and SENT_BYTES bytes, are sent to where
  the items are: items are read split by split, in as many tasks as their bytes ask for, and not shuffled.
* Beyond that, and where `match_on` sends items only to queries with the same value, items are
  shuffled: queries are hashed into groups of `cell_blocks` blocks, items into slots; a (group, slot) cell first
  receives its query rows, then streams its items past one block after the other.  Items are copied once a group, queries
  once a slot, and there are only as many slots as keep all tasks busy; under `match_on` a value has slots by its share of the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from hybridq.plans.stages import materialise

QUERY_BLOCK = 2048
ITEM_ROWS = 1024
#: Query blocks in one cell of the shuffled scan: items are copied for that many blocks at once.
CELL_BLOCKS = 16
#: Items of a slot under `match_on`, at least, where a family has more than one slot.
SLOT_ITEMS = 4096
SENT_BLOCKS = 8
SENT_BYTES = 32 << 20
MAX_TASKS = 50_000
#: No filter dropped, or up to the first to fifth of the relaxation order.
LEVELS = 6


def block_scan(
    queries: DataFrame,
    items: DataFrame,
    task,
    schema: str,
    query_key: str = "query_id",
    item_key: str = "document_id",
    match_on: str | None = None,
    query_block: int = QUERY_BLOCK,
    sent_blocks: int = SENT_BLOCKS,
    cell_blocks: int = CELL_BLOCKS,
    together: str | None = None,
) -> DataFrame:
    """`together` is a column of the items: shuffled, those with the same value stay next to each other."""
    queries = materialise(queries, "asking")  # counted and read below
    blocks = max(1, math.ceil(queries.count() / query_block))
    if match_on is None and blocks <= sent_blocks:
        sent = [_sent_block(queries, query_key, blocks, i) for i in range(blocks)]
        if all(table.nbytes <= SENT_BYTES for table in sent):
            return _scan_in_place(items, [table for table in sent if len(table)], task, schema)
    return _scan_shuffled(queries, items, task, schema, query_key, item_key, match_on, math.ceil(blocks / cell_blocks), query_block, together)


def _block(query_key: str, blocks: int):
    return F.pmod(F.xxhash64(query_key), F.lit(blocks))


def _sent_block(queries: DataFrame, query_key: str, blocks: int, i: int) -> pa.Table:
    """About query_block rows; one row group more than SENT_BYTES shows that they don't fit."""
    return queries.where(_block(query_key, blocks) == i).toArrow()


def _scan_in_place(items: DataFrame, sent: list[pa.Table], task, schema: str) -> DataFrame:
    spark = items.sparkSession
    out = None
    for table in sent:
        shared = spark.sparkContext.broadcast(_packed(table))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            state = task.prepare(pa.ipc.open_stream(shared.value).read_all())
            for batch in batches:
                whole = pa.Table.from_batches([batch])
                for low in range(0, len(whole), ITEM_ROWS):
                    # what a task can't hold it gives out as it goes
                    yield from task.fold(state, whole.slice(low, ITEM_ROWS)) or ()
            yield from task.finish(state)

        part = items.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _scan_shuffled(queries, items, task, schema, query_key, item_key, match_on, blocks, query_block, together=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _run(batches, task, query_block)

    return _cells(queries, items, query_key, item_key, match_on, blocks, together).mapInArrow(run, schema)


def _cells(queries, items, query_key, item_key, match_on, blocks, together=None) -> DataFrame:
    """Both sides dealt to the tasks, in each cell its queries before its items."""
    spark = queries.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = math.ceil(partitions / blocks)
    if match_on:
        per_family = _family_slots(queries, items, match_on, partitions, most)
        firsts = [blocks * s for s in itertools.accumulate(per_family, initial=0)]
        family = F.pmod(F.xxhash64(match_on), F.lit(partitions)).cast("int")
        slots, first = (F.get(F.array(*[F.lit(n).cast("long") for n in values]), family) for values in (per_family, firsts[:-1]))
        n_cells = firsts[-1]
    else:
        slots, first, n_cells = F.lit(most).cast("long"), F.lit(0).cast("long"), blocks * most

    def cell(block, slot):
        return (first + block * slots + slot).alias("_cell")

    each_slot = F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("_slot")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    own_block = _block(query_key, blocks).alias("_block")
    own_slot = F.pmod(F.xxhash64(together or item_key), slots).alias("_slot")

    q = queries.select("*", each_slot).select(
        cell(own_block, F.col("_slot")),
        F.lit(0).alias("_side"),
        *[F.col(c).alias(f"q_{c}") for c in queries.columns],
    )
    x = items.select("*", each_block).select(
        cell(F.col("_block"), own_slot),
        F.lit(1).alias("_side"),
        *[F.col(c).alias(f"x_{c}") for c in items.columns],
    )
    both = q.unionByName(x, allowMissingColumns=True)
    tasks = min(n_cells, blocks * most * 4, MAX_TASKS)
    order = ["_cell", "_side", *([f"x_{together}"] if together else [])]
    return both.repartitionById(tasks, F.pmod("_cell", F.lit(tasks)).cast("int")).sortWithinPartitions(*order)


def _family_slots(queries, items, match_on, families, most) -> list[int]:
    """Slots of each family (values of `match_on` with one hash): its share of all pairs, and none of few items.

    A query is copied to every slot of its family, and each of them gives out its own best items."""
    family = F.pmod(F.xxhash64(match_on), F.lit(families)).cast("int").alias("family")
    asked, offered = (dict(df.select(family).groupBy("family").count().collect()) for df in (queries, items))
    pairs = {f: n * offered.get(f, 0) for f, n in asked.items()}
    share = most / max(1, sum(pairs.values()))
    return [max(1, min(math.ceil(pairs.get(f, 0) * share), math.ceil(offered.get(f, 0) / SLOT_ITEMS))) for f in range(families)]


def _run(batches, task, query_block):
    cell, waiting, states = None, [], []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        cells = np.asarray(table.column("_cell"))
        sides = np.asarray(table.column("_side"))
        if len(cells) == 0:
            continue
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(cells)]):
            piece = table.slice(start, stop - start)
            if cells[start] != cell:
                for state in states:
                    yield from task.finish(state)
                cell, waiting, states = cells[start], [], []
            if sides[start] == 0:
                waiting.append(_side(piece, "q_"))
            elif waiting or states:
                if not states:
                    asked, waiting = pa.concat_tables(waiting), []
                    states = [task.prepare(asked.slice(low, query_block)) for low in range(0, len(asked), query_block)]
                items = _side(piece, "x_")
                for low in range(0, len(items), ITEM_ROWS):
                    few = items.slice(low, ITEM_ROWS)
                    for state in states:
                        # what a task can't hold it gives out as it goes
                        yield from task.fold(state, few) or ()
    for state in states:
        yield from task.finish(state)


def _side(table: pa.Table, prefix: str) -> pa.Table:
    names = [n for n in table.column_names if n.startswith(prefix)]
    return table.select(names).rename_columns([n[len(prefix):] for n in names])


# ---------------------------------------------------------------------------
# Arrow -> numpy
# ---------------------------------------------------------------------------
def column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks) if table.column(name).num_chunks != 1 else table.column(
        name
    ).chunk(0)


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, element values) of a list column."""
    arr = column(table, name)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(arr), 0), dtype=np.int64)
    return np.repeat(np.arange(len(arr)), lengths), arr.flatten()


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """Numeric column as float64, NULL as NaN (never equal, never smaller, never larger)."""
    return column(table, name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def unit_matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, usable-row mask) from `idx`/`val` or `embedding` lists."""
    out = np.zeros((len(table), dims))
    usable = np.ones(len(table), dtype=bool)
    if "embedding" in table.column_names:
        rows, values = lists(table, "embedding")
        usable = np.bincount(rows, minlength=len(table)) == dims
        if len(rows):
            position = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            keep = usable[rows]
            out[rows[keep], position[keep]] = np.asarray(values, dtype=np.float64)[keep]
    else:
        rows, index = lists(table, "idx")
        _, values = lists(table, "val")
        out[rows, np.asarray(index, dtype=np.int64)] = np.asarray(values, dtype=np.float64)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    np.divide(out, norm, out=out, where=norm > 0)
    return out, usable


# ---------------------------------------------------------------------------
# Running top-k
# ---------------------------------------------------------------------------
class Best:
    """k best (score, id) per query; scores compare at nine decimals, then by id.

    Offers wait in a buffer of about as many rows as are kept, so the kept ones are not sorted for every batch."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.row = np.empty(0, dtype=np.int64)
        self.key = np.empty(0)
        self.score = np.empty(0)
        self.id = None
        self.waiting, self.n_waiting = [], 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        # a little below the k-th score seen so far; rows that aren't full yet look at this batch
        low = (self.floor - 1.0) * 1e-9
        unfilled = np.flatnonzero(self.floor == -np.inf)
        if len(unfilled) and scores.shape[1] > self.k:
            some = np.where(allowed[unfilled], scores[unfilled], -np.inf)
            low[unfilled] = np.partition(some, -self.k, axis=1)[:, -self.k] - 1e-9
        rows, cols = np.nonzero((scores >= low[:, None]) & allowed)
        self.offer_pairs(rows, scores[rows, cols], ids, cols)

    def offer_pairs(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, cols: np.ndarray) -> None:
        """One score for each pair of a query and an item (its place in `ids`)."""
        key = np.floor(scores * 1e9 + 0.5)
        good = key >= self.floor[rows]
        if not good.any():
            return
        self.waiting.append((rows[good], key[good], scores[good], ids[cols[good]]))
        self.n_waiting += len(self.waiting[-1][0])
        if self.n_waiting > max(len(self.row), OFFERS):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        row, key, score, found = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        self.row = np.concatenate([self.row, row])
        self.key = np.concatenate([self.key, key])
        self.score = np.concatenate([self.score, score])
        self.id = found if self.id is None else np.concatenate([self.id, found])
        order = np.lexsort((self.id, -self.key, self.row))
        row = self.row[order]
        keep = order[np.arange(len(row)) - np.searchsorted(row, row, side="left") < self.k]
        self.row, self.key, self.score, self.id = (a[keep] for a in (self.row, self.key, self.score, self.id))
        counts = np.bincount(self.row, minlength=len(self.floor))
        last = np.cumsum(counts) - 1
        full = counts == self.k
        self.floor[full] = self.key[last[full]]

    def batches(self, query_ids: pa.Array, item_type: pa.DataType, names: list[str]):
        self.settle()
        if self.id is None:
            return
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(self.row)), pa.array(self.id.tolist(), type=item_type), pa.array(self.score)],
            names=names,
        )


#: A multiplication through lists costs as much as this many in a matrix product.
SPARSE_COST = 25
#: A multiplication for a single pair costs about as much as this many through lists.
PAIR_COST = 1
#: Offers that wait before the best ones are sorted out.
OFFERS = 1 << 16


class SparseUnits:
    """Unit vectors given as `idx` and `val` lists, by coordinate, for products with other such rows."""

    def __init__(self, table: pa.Table, dims: int):
        rows, at, values = sparse_units(table)
        order = np.argsort(at, kind="stable")
        self.n, self.dims = len(table), dims
        self.rows, self.values = rows[order], values[order]
        self.start = np.searchsorted(at[order], np.arange(dims + 1))
        # the same entries by row
        self.at, self.by_row, self.width = at, values, np.bincount(rows, minlength=len(table))
        self.first = np.cumsum(self.width) - self.width

    def cost(self, at: np.ndarray) -> int:
        """How many products `dot` makes."""
        return int((self.start[at + 1] - self.start[at]).sum())

    def dot(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """All inner products with `n` other rows, given by their entries."""
        out = np.zeros(self.n * n)
        width = self.start[at + 1] - self.start[at]
        ends = np.cumsum(width)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 2_000_000, side="right")))
            w = width[low:high]
            place = np.repeat(self.start[at[low:high]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            cell = self.rows[place] * n + np.repeat(rows[low:high], w)
            out += np.bincount(cell, self.values[place] * np.repeat(values[low:high], w), minlength=len(out))
            low = high
        return out.reshape(self.n, n)


def sparse_units(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, value) of all entries of `idx`/`val` lists, rows scaled to length one."""
    rows, at = lists(table, "idx")
    values = np.asarray(lists(table, "val")[1], dtype=np.float64)
    norm = np.sqrt(np.bincount(rows, values * values, minlength=len(table)))[rows]
    return rows, np.asarray(at, dtype=np.int64), np.divide(values, norm, out=np.zeros(len(values)), where=norm > 0)


class CosineTopK:
    """Top-k items by cosine; `gate`, when given, limits the items each query may see."""

    def __init__(self, k: int, dims: int, query_key="query_id", item_key="document_id", gate=None):
        self.k, self.dims, self.query_key, self.item_key, self.gate = k, dims, query_key, item_key, gate

    def prepare(self, q: pa.Table):
        # a cell holds many blocks: hashed vectors stay lists, and become a matrix for the batches that ask for one
        hashed = "idx" in q.column_names
        matrix, usable = (None, np.ones(len(q), dtype=bool)) if hashed else unit_matrix(q, self.dims)
        return {
            "ids": column(q, self.query_key),
            "matrix": matrix,
            "usable": usable,
            "sparse": SparseUnits(q, self.dims) if hashed else None,
            "lists": q.select(["idx", "val"]) if hashed else None,
            "gate": self.gate.prepare(q) if self.gate else None,
            "best": Best(len(q), self.k),
            "type": None,
        }

    def fold(self, state, x: pa.Table) -> None:
        ids = column(x, self.item_key)
        state["type"] = ids.type
        if state["sparse"] is not None and "idx" in x.column_names and hasattr(self.gate, "allowed_pairs"):
            rows, cols = self.gate.allowed_pairs(state["gate"], x)
            if len(rows):
                state["best"].offer_pairs(rows, self._pair_scores(state, x, rows, cols), self._once(x, "ids", lambda: np.array(ids.to_pylist())), cols)
            return
        scores, usable = self._scores(state, x)
        allowed = state["usable"][:, None] & usable[None, :]
        if self.gate:
            allowed &= self.gate.allowed(state["gate"], x)
        state["best"].offer(scores, self._once(x, "ids", lambda: np.array(ids.to_pylist())), allowed)

    def _once(self, x: pa.Table, name: str, make):
        """make() once for all query blocks that meet the same items."""
        seen = self.__dict__.setdefault("_seen", {})
        if seen.get("x") is not x:
            seen.clear()
            seen["x"] = x
        if name not in seen:
            seen[name] = make()
        return seen[name]

    def _pair_scores(self, state, x: pa.Table, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores of single pairs; where most pairs are asked, of all."""
        units = state["sparse"]
        width = units.width[rows]
        made = int(width.sum())
        entries = self._once(x, "entries", lambda: sparse_units(x))
        if made * PAIR_COST > min(units.cost(entries[1]), units.n * len(x) * self.dims // SPARSE_COST):
            return self._scores(state, x)[0][rows, cols]
        # by coordinate, so that the pairs of one query stay in few rows
        matrix = self._once(x, "matrix", lambda: np.ascontiguousarray(unit_matrix(x, self.dims)[0].T).ravel())
        out = np.empty(len(rows))
        ends = np.cumsum(width)
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 1_000_000, side="right")))
            w = width[low:high]
            place = np.repeat(units.first[rows[low:high]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            products = matrix.take(units.at[place] * len(x) + np.repeat(cols[low:high], w)) * units.by_row[place]
            out[low:high] = np.bincount(np.repeat(np.arange(high - low), w), products, minlength=high - low)
            low = high
        return out

    def _scores(self, state, x: pa.Table):
        units = state["sparse"]
        if units is not None and "idx" in x.column_names:
            entries = self._once(x, "entries", lambda: sparse_units(x))
            if units.cost(entries[1]) * SPARSE_COST < units.n * len(x) * self.dims:
                return units.dot(*entries, len(x)), np.ones(len(x), dtype=bool)
        asked = unit_matrix(state["lists"], self.dims)[0] if state["matrix"] is None else state["matrix"]
        matrix, usable = self._once(x, "units", lambda: unit_matrix(x, self.dims))
        return asked @ matrix.T, usable

    def finish(self, state):
        yield from state["best"].batches(state["ids"], state["type"], [self.query_key, self.item_key, "score"])


class SameGroup:
    """Gate: item and query carry the same value of one column."""

    def __init__(self, name: str):
        self.name = name

    def prepare(self, q):
        return np.array(column(q, self.name).to_pylist())

    def allowed(self, prepared, x):
        return prepared[:, None] == np.array(column(x, self.name).to_pylist())[None, :]
