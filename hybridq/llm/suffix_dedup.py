"""Removal of long repeated strings by suffix arrays over shards of the corpus.

A byte goes when it is covered by a `window`-byte string that starts at another place too, in
any document.  Windows that may be equal are brought together first:

* Each window is named by the smallest hash among its k-byte strings; equal windows
  have equal names, and neighbouring windows mostly share one.  A run of neighbours with one
  name is a segment.  A name that one segment has, with its naming string in one place, is done with.
* A name whose segments are several identical ones needs no sorting either: all its windows repeat.
* The remaining names hold segments that partly agree.  One copy of each distinct segment goes to
  a shard, which sorts all suffixes by induction, computes permuted common prefixes, and
  marks windows whose prefix with a neighbour reaches the window size.
* A name with more than `hot_bytes` of distinct segments (a passage that a large part of the
  corpus quotes in different surroundings) isn't sent to one task: its windows are named again by longer
  strings, rung by rung of `ladder`.  On the last rung the string is the window itself.

Shuffled are 50 bytes a segment (a segment starts every 140 bytes or so), the texts
of ambiguous segments, and texts by row to fetch segments and to cut.  Copies meet as counts,
never as rows of one task, apart from joins that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from hybridq.llm.arrow import by_bytes, slices, spans, text_bytes
from hybridq.llm.exact_dedup import located
from hybridq.llm.suffix_array import permuted_prefixes, suffix_array
from hybridq.plans.stages import drop_stage, materialise

WINDOW = 400
LADDER = (0.32, 0.66, 0.84, 0.96, 1.0)
HOT_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
#: Texts hashed together, and windows in one segment at most.
GROUP_BYTES = 1 << 20
RUN = 4096
BASE = 0x9E3779B97F4A7C15
SEGMENT = "id long, tag long, start int, n int, key long, d0 long, d1 long, twice boolean"


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k-byte string."""
    n = len(data) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    value = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * _powers(BASE, len(data)), out=sums[1:])
    h = (sums[k:] - sums[:n]) * _powers(pow(BASE, -1, 1 << 64), n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """At each position, the minimum of the next `width` values."""
    n, size = len(h), 1
    if n < width:
        return np.empty(0, dtype=h.dtype)
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: n - width + 1], h[width - size : n - size + 1])


def segments(data: np.ndarray, offsets: np.ndarray, k: int, window: int, chosen: np.ndarray | None = None):
    """(document, start in document, windows, name, whether the naming string stands in it twice) of each segment.

    `chosen` masks windows by their start.
    """
    width = window - k + 1
    h = hashes(data, k)
    key = smallest(h, width)
    if not len(key):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    valid = np.zeros(len(key) + 1, dtype=bool)
    lengths = np.maximum(np.diff(offsets) - window + 1, 0)
    valid[spans(offsets[:-1], lengths)] = True
    if chosen is not None:
        valid[:-1] &= chosen[: len(key)]
    # the last starts of a document are no windows, so runs end there (a window has two bytes at least)
    first = valid[:-1].copy()
    first[1:] &= ~valid[:-2] | (key[1:] != key[:-1])
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(valid[:-1] & (np.append(first[1:], True) | ~valid[1:])) + 1
    pieces = -(-(stops - starts) // RUN)
    if (pieces > 1).any():
        starts = spans(np.zeros_like(pieces), pieces) * RUN + np.repeat(starts, pieces)
        stops = np.minimum(starts + RUN, np.repeat(stops, pieces))
    document = np.searchsorted(offsets, starts, side="right") - 1
    # a string names some window around it if the largest name of those windows is its hash
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(h == ~smallest(~np.concatenate([edge, key, edge]), width))
    low, high = np.searchsorted(at, starts), np.searchsorted(at, stops + width - 1)
    same = h[at[spans(low, high - low)]] == np.repeat(key[starts], high - low)
    twice = np.bincount(np.repeat(np.arange(len(starts)), high - low), same, minlength=len(starts)) > 1
    return document, starts - offsets[document], stops - starts, key[starts], twice


def _segmenter(k: int, window: int, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP_BYTES, side="right")) - 1)
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                chosen = _mask(batch.column("spans").slice(low, high - low), at, len(part)) if masked else None
                doc, start, n, key, twice = segments(part, at, k, window, chosen)
                raw = part.tobytes()
                begin = at[doc] + start
                digests = [
                    hashlib.blake2b(raw[a:b], digest_size=16).digest()
                    for a, b in zip(begin.tolist(), (begin + n + window - 1).tolist())
                ]
                pair = np.array([np.frombuffer(d, dtype=np.int64) for d in digests], dtype=np.int64).reshape(-1, 2)
                rows = pa.array(doc + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows), batch.column("tag").take(rows), pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(twice),
                    ],
                    ["id", "tag", "start", "n", "key", "d0", "d1", "twice"],
                )
                low = high

    return run


def _mask(column: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """True at each window start inside the (start, n) spans of the documents."""
    flat = column.flatten()
    counts = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    start, n = np.asarray(flat.field("start"), dtype=np.int64), np.asarray(flat.field("n"), dtype=np.int64)
    out = np.zeros(size, dtype=bool)
    out[spans(start + np.repeat(at[:-1], counts), n)] = True
    return out


def repeats_in_shard(pieces: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each piece, the runs (start, length) of windows that stand at another place of the shard too."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    # bytes become symbols from 2 on; 1 ends a piece and 0 the shard
    s = np.ones(len(data) + len(pieces) + 1, dtype=np.int64)
    s[-1] = 0
    starts = np.cumsum(sizes + 1) - sizes - 1
    s[spans(starts, sizes)] = data.astype(np.int64) + 2
    sa = suffix_array(s, 258)
    common, phi = permuted_prefixes(s, sa)
    left = np.zeros(len(s), dtype=np.int64)
    left[spans(starts, sizes)] = np.repeat(sizes, sizes) - spans(np.zeros_like(sizes), sizes)
    known = np.flatnonzero(phi >= 0)
    reach = np.minimum(np.minimum(common[known], left[known]), left[phi[known]])
    hit = np.zeros(len(s) + 1, dtype=bool)
    both = known[reach >= window]
    hit[both] = True
    hit[phi[both]] = True
    # a piece ends with a symbol that is no hit, so runs never cross pieces
    edges = np.flatnonzero(np.diff(np.append(False, hit).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for a, b in edges.reshape(-1, 2).tolist():
        i = int(np.searchsorted(starts, a, side="right")) - 1
        out[i].append((a - int(starts[i]), b - a))
    return out


def _sorter(window: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def emit():
            runs = repeats_in_shard([h[4] for h in held], window)
            # a segment with several copies repeats as a whole
            found = [r if h[3] == 1 else [(0, len(h[4]) - window + 1)] for h, r in zip(held, runs)]
            rows = [(h[0], h[1], h[2], f) for h, f in zip(held, found) if f]
            kind = pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32())]))
            cells = [[{"at": a, "len": b} for a, b in r[3]] for r in rows]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array(cells, kind)], ["key", "d0", "d1", "runs"]
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "d0", "d1", "c", "segment"))):
                if size > shard_bytes and row[0] != held[-1][0]:
                    yield emit()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield emit()

    return run


def _fetcher(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            counts = np.asarray(pa.compute.list_value_length(wanted), dtype=np.int64)
            flat = wanted.flatten()
            begin = np.repeat(offsets[:-1], counts) + np.asarray(flat.field("start"), dtype=np.int64)
            size = np.asarray(flat.field("n"), dtype=np.int64) + window - 1
            cut = slices(data[spans(begin, size)], np.cumsum(size) - size)
            names_ = ["key", "d0", "d1", "c"]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names_), cut.cast(pa.binary())], [*names_, "segment"])

    return run


def _marks(source: DataFrame, window: int, ladder, hot_bytes: int, shard_bytes: int) -> list[tuple[DataFrame, DataFrame]]:
    """[(shared segments, runs of repeated windows by segment content), ...], one pair a rung."""
    spark = source.sparkSession
    out = []
    pending, masked = source, False
    for rung, share in enumerate(ladder):
        k = max(1, round(window * share))
        found = materialise(pending.mapInArrow(_segmenter(k, window, masked), SEGMENT), "segments")
        common = found.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("t")).where("c > 1 OR t").select("key")
        common = materialise(common, "names")  # as a table, so that Spark can split the join at a hot name
        shared = materialise(found.drop("twice").join(common, "key"), "shared")
        drop_stage(found)
        # one row per distinct segment, with any of its places
        groups = materialise(
            shared.groupBy("key", "d0", "d1").agg(
                F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("id", "tag", "start", "n")]
            ),
            "groups",
        )
        by_key = groups.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + window - 1).alias("bytes"))
        last = rung == len(ladder) - 1
        by_key = by_key.withColumn("hot", F.lit(False) if last else (F.col("kinds") > 1) & (F.col("bytes") > hot_bytes))
        groups = materialise(groups.join(by_key, "key"), "kinds")
        whole = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("len")))
        same = groups.where("kinds = 1 AND c > 1").select("key", "d0", "d1", whole.alias("runs"))
        differ = groups.where("(kinds > 1 OR c = 1) AND NOT hot")
        wanted = differ.groupBy("id", "tag").agg(F.collect_list(F.struct("key", "d0", "d1", "c", "start", "n")).alias("wanted"))
        texts = source.join(wanted, ["id", "tag"]).select("text", "wanted")
        pieces = texts.mapInArrow(_fetcher(window), "key long, d0 long, d1 long, c long, segment binary")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = pieces.repartition(parts, "key").sortWithinPartitions("key")
        runs = shards.mapInArrow(_sorter(window, shard_bytes), "key long, d0 long, d1 long, runs array<struct<at:int,len:int>>")
        out.append((shared, materialise(same.unionByName(runs), "runs")))
        hot = groups.where("hot").select("key").distinct()
        if last or hot.isEmpty():
            break
        open_ = shared.join(hot, "key").groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
        pending, masked = source.join(open_, ["id", "tag"]), True
    return out


def _cutter(window: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            data, offsets = text_bytes(batch.column("text"))
            hits = batch.column("hits")
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(hits), 0), dtype=np.int64)
            flat = hits.flatten()
            begin = np.asarray(flat.field("at"), dtype=np.int64) + np.repeat(offsets[:-1], counts)
            end = begin + np.asarray(flat.field("len"), dtype=np.int64) + window - 1
            depth = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(depth, begin, 1)
            np.subtract.at(depth, end, 1)
            gone = np.cumsum(depth[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            opens[starts] = gone[starts]
            total, runs, left = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens, ~gone))
            kept = slices(data[~gone], left[offsets[:-1]])
            kept = pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string()) if as_text else kept.cast(pa.binary())
            columns = [np.diff(offsets), np.diff(total[offsets]), np.diff(runs[offsets])]
            others = [n for n in batch.schema.names if n not in ("text", "hits")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in others), *(pa.array(c.astype(np.int64)) for c in columns), kept],
                [*others, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def suffix_dedup(
    docs: DataFrame, window: int = WINDOW, ladder=LADDER, hot_bytes: int = HOT_BYTES, shard_bytes: int = SHARD_BYTES, as_text: bool = False
) -> DataFrame:
    """The columns of `docs` (doc_id, text, ...) but text, with n_bytes, n_removed, n_spans and kept.

    n_spans counts maximal removed runs; kept has the bytes that stay, as binary or (`as_text`) as a string
    without the bytes of letters that were cut apart.  Strings are judged on
    the input.  Null counts as empty; texts shorter than the window keep all; a
    repeated row repeats all its windows; null ids are allowed; an empty table gives no rows.  `ladder` has the
    lengths of naming strings as shares of the window.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    clash = [c for c in others if c in ("id", "tag", "hits", "kept", "n_bytes", "n_removed", "n_spans")]
    if clash:  # own names win; the others come back under a longer name
        docs = docs.withColumnsRenamed({c: f"{c}_in" for c in clash})
        others = [f"{c}_in" if c in clash else c for c in others]
    rows = located(docs).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    rows = rows.withColumn("tag", F.xxhash64("_file", "_row"))
    hits = None
    for shared, runs in _marks(rows.select("id", "tag", "text"), window, ladder, hot_bytes, shard_bytes):
        part = shared.join(runs, ["key", "d0", "d1"]).select("id", "tag", F.col("start").alias("base"), F.explode("runs").alias("r"))
        part = part.select("id", "tag", (F.col("base") + F.col("r.at")).alias("at"), F.col("r.len").alias("len"))
        hits = part if hits is None else hits.unionByName(part)
    by_row = hits.groupBy("id", "tag").agg(F.collect_list(F.struct("at", "len")).alias("hits"))
    joined = rows.join(by_row, ["id", "tag"], "left").select("doc_id", "text", "hits", *others)
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    ddl = ", ".join(f"`{n}` {kinds[n]}" for n in ["doc_id", *others])
    kept = "string" if as_text else "binary"
    return joined.mapInArrow(_cutter(window, as_text), f"{ddl}, n_bytes long, n_removed long, n_spans long, kept {kept}")


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with the bytes that stay as text; bytes of a letter that was cut apart go too.

    n_chars, where there is one, is counted anew.  Null text becomes empty.
    """
    found = suffix_dedup(docs, as_text=True, **settings)
    names = {"text": "kept"} | {c: c if c in found.columns else f"{c}_in" for c in docs.columns if c != "text"}
    if "kept" in docs.columns:
        names["kept"] = "kept_in"
    out = found.select(*[F.col(names[c]).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
