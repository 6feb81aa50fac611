"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Index: every vector is centred, normalised and rotated by a random orthogonal matrix; the
signs of the rotated components are packed into bits.  Beside the bits two correction scalars
are kept: the norm, and the inner product of the unit vector with its own code.
Search: a query is centred and rotated once and quantised to PLANES bit planes, so the inner
product with a code is a sum of popcounts of packed words.  Dividing by the code's own inner
product gives an unbiased estimate; its error is within EPSILON / sqrt(dims - 1) times a
known factor with overwhelming probability.  Only vectors whose lower bound on the distance
doesn't exceed the k-th smallest upper bound of the query are reranked by exact distance.

Plan: equal vectors are one index entry with their k + 1 smallest ids (more can't be
needed), so a vector that a third of the rows share costs no more than another.  Blocks of
queries meet slots of codes; codes travel, not vectors.  A cell keeps its
candidates and k bounds per query; the exact vectors are joined for candidates only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq.llm.arrow import text_bytes
from hybridq.plans.blockscan import block_scan
from hybridq.plans.stages import materialise

EPSILON = 2.2
PLANES = 7
#: Bits a dimension: vectors are padded with zeros before the rotation, which narrows the bounds.
EXPAND = 8
SEED = 20
CODED = "item long, dims int, bits binary, norm double, own double"


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrix for vectors padded to EXPAND times the size; the same on every machine."""
    size = -(-dims * EXPAND // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _rotated(x: np.ndarray, centre: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotated unit vectors, norms) of the centred rows."""
    turn = rotation(dims)
    x = x - centre
    norm = np.sqrt((x * x).sum(axis=1))
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    return unit @ turn[:dims], norm  # padding is zero and meets no row


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms, inner products of the unit vectors with their codes)."""
    turned, norm = _rotated(x, centre, x.shape[1])
    bits = np.packbits(turned > 0, axis=1)
    return bits, norm, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


class Planes:
    """Queries as bit planes of their quantised rotated components."""

    def __init__(self, x: np.ndarray, centre: np.ndarray):
        turned, self.norm = _rotated(x, centre, x.shape[1])
        self.size = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**PLANES - 1), 1e-30)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        planes = [np.packbits((levels >> k) & 1, axis=1) for k in range(PLANES)]
        self.planes = [np.ascontiguousarray(p).view(np.uint64) for p in planes]
        self.sum = self.low * self.size + self.step * levels.sum(axis=1)

    def estimate(self, bits: np.ndarray, norm: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distance for all queries (rows) and codes (columns)."""
        words = bits.view(np.uint64)
        ones = np.bitwise_count(words).sum(axis=1).astype(np.float64)
        dot = np.zeros((len(self.norm), len(words)))
        for k, plane in enumerate(self.planes):
            hit = np.zeros(dot.shape, dtype=np.int32)
            for w in range(words.shape[1]):
                hit += np.bitwise_count(plane[:, w, None] & words[None, :, w])
            dot += hit * float(1 << k)
        # sum of +-q over the signs is twice the sum over set bits less the whole sum
        dot = 2 * (self.low[:, None] * ones[None] + self.step[:, None] * dot) - self.sum[:, None]
        dot /= np.sqrt(self.size)
        own = np.maximum(own, 1e-9)
        near = dot / own[None]
        error = EPSILON * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(self.size - 1, 1))
        # a component is off by a uniform error within half a step
        error = error[None] + (EPSILON * self.step / np.sqrt(12))[:, None] / own[None]
        base = self.norm[:, None] ** 2 + norm[None] ** 2
        scale = 2 * self.norm[:, None] * norm[None]
        return base - scale * np.minimum(near + error, 1), base - scale * np.maximum(near - error, -1)


class _Search:
    """The block scan's task: candidates of a block of queries among a slot of codes."""

    def __init__(self, k: int, centres: dict[int, np.ndarray]):
        self.k, self.centres = k, centres

    def prepare(self, table: pa.Table):
        dims = np.asarray(table.column("dims"))
        states = {}
        for d in np.unique(dims):
            rows = table.filter(pa.array(dims == d))
            ids = np.asarray(rows.column("query_id"))
            states[int(d)] = {
                "ids": ids, "alone": np.asarray(rows.column("alone")), "found": [], "upper": np.full((len(ids), self.k), np.inf),
                "planes": Planes(_matrix(rows.column("embedding").combine_chunks(), d), self.centres[d]),
            }
        return states

    def fold(self, states, table: pa.Table) -> None:
        dims = np.asarray(table.column("dims"))
        for d in set(dims.tolist()) & set(states):
            self._fold(states[d], table.filter(pa.array(dims == d)))

    def _fold(self, state, table: pa.Table) -> None:
        item = np.asarray(table.column("item"))
        raw, _ = text_bytes(table.column("bits").combine_chunks())
        bits = np.ascontiguousarray(raw.reshape(len(item), -1))
        lower, upper = state["planes"].estimate(bits, np.asarray(table.column("norm")), np.asarray(table.column("own")))
        upper[state["alone"][:, None] == item[None]] = np.inf  # nothing but the query itself
        best = np.partition(np.concatenate([state["upper"], upper], axis=1), self.k - 1, axis=1)[:, : self.k]
        state["upper"] = best
        q, i = np.nonzero((lower <= best.max(axis=1)[:, None]) & np.isfinite(upper))
        state["found"].append((q, item[i], lower[q, i], upper[q, i]))
        if sum(len(f[0]) for f in state["found"]) > 4_000_000:
            state["found"] = [self._trim(state)]

    def _trim(self, state):
        q, item, lower, upper = (np.concatenate(c) for c in zip(*state["found"]))
        keep = lower <= state["upper"].max(axis=1)[q]
        return q[keep], item[keep], lower[keep], upper[keep]

    def finish(self, states):
        for state in states.values():
            if state["found"]:
                q, item, lower, upper = self._trim(state)
                for low in range(0, len(q), 100_000):
                    cut = slice(low, low + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in (state["ids"][q[cut]], item[cut], lower[cut], upper[cut])],
                        ["query_id", "item", "lower", "upper"],
                    )


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two arrays in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of float or double) without rows that take no part; repeated rows once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(finite & some).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").dropDuplicates()


def build_index(vectors: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """(table of item, ids, dims, embedding; table of codes; centre of each dimensionality).

    An item is a distinct vector, named by its smallest vec_id; ids has its k + 1 smallest.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entry = (
        usable(vectors).withColumn("rank", rank).where(F.col("rank") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("item"), "ids", F.size("embedding").alias("dims"), "embedding")
    )
    entry = materialise(entry, "vectors")
    parts = entry.select("dims", F.posexplode("embedding").alias("pos", "x"))
    # one row per dimension of each vector length
    means = parts.groupBy("dims", "pos").agg(F.avg("x").alias("x")).orderBy("dims", "pos").collect()
    centres = {d: np.array([r.x for r in means if r.dims == d]) for d in {r.dims for r in means}}

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dims"))
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                bits, norm, own = encode(_matrix(rows.column("embedding"), d), centres[d])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("item"), rows.column("dims"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(own)],
                    ["item", "dims", "bits", "norm", "own"],
                )

    codes = materialise(entry.select("item", "dims", "embedding").mapInArrow(run, CODED), "codes")
    return entry, codes, centres


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` for each row of `queries` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components take no part, as
    queries or candidates; vectors of different lengths don't compare.  A query never finds its own vec_id.
    Ties go to the smaller vec_id.  Repeated rows count once.  Fewer than k
    candidates: all of them; an empty table: no rows.  Other columns don't matter.
    """
    entry, codes, centres = build_index(vectors, k)
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("embedding"), F.size("embedding").alias("dims"))
    # the entry that holds nothing but the query itself
    single = entry.where(F.size("ids") == 1).select(F.col("item").alias("alone"))
    asked = asked.join(single, F.col("query_id") == F.col("alone"), "left").withColumn("alone", F.coalesce("alone", F.lit(-(1 << 62)).cast("long")))
    asked = materialise(asked, "asked")
    found = materialise(
        block_scan(
            asked, codes, _Search(k, centres), "query_id long, item long, lower double, upper double",
            query_key="query_id", item_key="item", cell_blocks=1,  # a block may keep many bounds
        ),
        "bounds",
    )
    by_upper = F.row_number().over(Window.partitionBy("query_id").orderBy("upper"))
    limit = found.withColumn("r", by_upper).where(F.col("r") <= k).groupBy("query_id").agg(
        F.max("upper").alias("most"), F.count(F.lit(1)).alias("c")
    )
    # with fewer than k bounds everything is a candidate
    chosen = found.join(limit, "query_id").where((F.col("lower") <= F.col("most")) | (F.col("c") < k)).select("query_id", "item")
    exact = (
        chosen.join(asked.select("query_id", F.col("embedding").alias("wanted")), "query_id")
        .join(entry.select("item", "ids", "embedding"), "item")
        .where(F.size("wanted") == F.size("embedding"))
        .select("query_id", F.explode("ids").alias("vec_id"), distance("wanted", "embedding").alias("score"))
        .where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    )
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
