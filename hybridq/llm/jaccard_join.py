"""Exact Jaccard join of word n-gram sets with prefix trees.

Documents are sets of distinct shingles of `words` words.  Two link when
100 * |intersection| >= percent * |union|.  Every step is exact up to collisions of 64-bit shingle
hashes inside one pair (about 1e-13 a pair).

1. Sketch: one pass makes the sets.  For half of all shingles (by hash, so the same half for
   every document) their 6-byte fingerprints go to buckets in sorted arrays, after each block has reduced
   shingles it saw several times to one witness.  A bucket tells each block how many of a document's
   shingles another document has, and lists frequent ones.  A document whose unshared
   shingles exceed what the threshold allows can't link and is done.
2. The rest are collapsed to distinct sets, ordered rarest shingle first; the global order needs
   only be the same for all, so the table of frequent shingles may be bounded (FREQUENT).  Shingles
   of the half that was not counted come after the rare ones: a quarter of a set is looked up, so
   they are only where more than half of what was counted is frequent.
3. Sets that link share a shingle among the first size - ceil(size * percent%) + 1 of each.
   The sets of such a shingle meet under its leader, the smallest set that has it; shingles
   with the same leader meet once.
4. Groups are joined in a prefix tree (prefix_tree.py).  A group above `group_sets` is cut into pieces that all hold
   the leader; afterwards sets outside the group's main component meet every piece.
5. Components of all edges, then the smallest doc_id of each.

Nothing is emitted per pair of a group; all that is broadcast is the bounded frequency table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hybridq.llm.arrow import by_bytes, spans, text_bytes
from hybridq.llm.components import components
from hybridq.llm.exact_dedup import as_scan, located
from hybridq.llm.prefix_tree import group_links
from hybridq.plans.stages import drop_stage, materialise, release

WORDS, PERCENT = 5, 75
GROUP_SETS = 4000
#: Frequent shingles that the global order knows by count, and the smallest such count.
FREQUENT, FREQUENT_FROM = 100_000, 6
GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
WITNESS = 0xFFFF
NO_ID = -(1 << 63)
BLOCK_DOCS = 0xFFF0
SKETCH = (
    "kind int, block long, bucket int, id array<long>, tag array<long>, n array<int>, sampled array<int>, own array<int>, "
    "d0 array<long>, d1 array<long>, prints binary, docs binary, more binary"
)
ANSWER = "block long, docs binary, counts binary, shingle long, df long"
SETS = "id long, tag long, n int, d0 long, d1 long, near boolean"


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z, white space separates words."""
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    inside = ~((lower == 0x20) | ((lower >= 0x09) & (lower <= 0x0D)))
    filled = np.diff(offsets) > 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    closes[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(begin):
        return [np.empty(0, np.uint64)] * (len(offsets) - 1)
    value = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[lower] * _powers(BASE, len(data)), out=sums[1:])
    word = _mix((sums[end] - sums[begin]) * _powers(pow(BASE, -1, 1 << 64), len(data))[begin] + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, offsets)
    count = np.diff(first)
    factors = [np.uint64(f) for f in np.random.default_rng(29).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
    room = max(len(word) - words + 1, 0)
    rolled = np.zeros(room, dtype=np.uint64)
    for k, f in enumerate(factors):
        rolled += word[k : k + room] * f
    rolled = _mix(rolled)
    out = []
    for i, c in enumerate(count.tolist()):
        a = int(first[i])
        if c >= words:
            out.append(np.unique(rolled[a : a + c - words + 1]))
        elif c:
            with np.errstate(over="ignore"):
                h = sum((word[a + k] * factors[k] for k in range(c)), np.uint64(c))
            out.append(_mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sketch(words: int, buckets: int):
    bits = int(buckets).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in by_bytes(batches, "text"):
            for low in range(0, whole.num_rows, BLOCK_DOCS):
                yield from block(whole.slice(low, BLOCK_DOCS), number)
                number += 1

    def block(batch: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column("text"))
        sets: list[np.ndarray] = []
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP_BYTES, side="right")) - 1)
            sets += shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words)
            low = high
        # sorted, so the lower half of all hashes comes first
        half = np.uint64(1 << 63)
        sampled = np.array([int(np.searchsorted(s, half)) for s in sets], dtype=np.int64)
        prints = np.concatenate([s[:m] for s, m in zip(sets, sampled.tolist())]) if sets else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), sampled)
        order = np.argsort(prints, kind="stable")
        prints, doc = prints[order], doc[order]
        if len(prints):
            start = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
            times = np.diff(np.append(start, len(prints)))
            own = np.bincount(doc[np.repeat(times > 1, times)], minlength=len(sets))
            prints, doc = prints[start], np.where(times > 1, WITNESS, doc[start]).astype("<u2")
        else:
            own, times, doc = np.zeros(len(sets), np.int64), np.empty(0, np.int64), doc.astype("<u2")
        digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
        pair = np.array(digests, dtype=np.int64).reshape(-1, 2)
        # 31 bits of bucket and more, then 32 bits of print: the first bit is 0 in this half
        code = prints >> np.uint64(31 - bits)
        bucket = (code >> np.uint64(32)).astype(np.int64)
        low32 = (code & np.uint64(0xFFFFFFFF)).astype("<u4")
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
        head = {
            "kind": 0, "block": number, "bucket": 0, "id": batch.column("id").to_pylist(), "tag": batch.column("tag").to_pylist(),
            "n": [len(s) for s in sets], "sampled": sampled.tolist(), "own": own.tolist(), "d0": pair[:, 0].tolist(), "d1": pair[:, 1].tolist(),
        }
        rows = [head]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
            more = times[a:b][times[a:b] > 1]
            rows.append({
                "kind": 1, "block": number, "bucket": int(bucket[a]), "prints": low32[a:b].tobytes(), "docs": doc[a:b].tobytes(),
                "more": more.astype("<u4").tobytes(),
            })
        many, long_, ints = pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32())
        kinds = [pa.int32(), long_, pa.int32(), many, many, ints, ints, ints, many, many, pa.binary(), pa.binary(), pa.binary()]
        names = ["kind", "block", "bucket", "id", "tag", "n", "sampled", "own", "d0", "d1", "prints", "docs", "more"]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(names, kinds)], names)

    return run


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; each is answered once all of its blocks are there."""

    def answer(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        prints = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
        docs = np.concatenate([np.frombuffer(r[2], "<u2") for r in rows])
        block = np.repeat(np.arange(len(rows)), [len(r[2]) // 2 for r in rows])
        times = np.ones(len(prints), dtype=np.int64)
        times[docs == WITNESS] = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
        value, at = np.unique(prints, return_inverse=True)
        df = np.bincount(at, times).astype(np.int64)
        hit = (df[at] > 1) & (docs != WITNESS)
        who, n = np.unique((block[hit] << 16) | docs[hit].astype(np.int64), return_counts=True)
        cuts = np.flatnonzero(np.diff(who >> 16)) + 1
        out = [
            (rows[int(w[0] >> 16)][0], (w & 0xFFFF).astype("<u2").tobytes(), c.astype("<u4").tobytes(), None, None)
            for w, c in zip(np.split(who, cuts), np.split(n, cuts))
            if len(w)
        ]
        often = np.flatnonzero(df >= FREQUENT_FROM)
        code = (np.int64(bucket) << 32) | value[often].astype(np.int64)
        out += [(None, None, None, c, d) for c, d in zip(code.tolist(), df[often].tolist())]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["block", "docs", "counts", "shingle", "df"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    bucket, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "prints", "docs", "more"))):
            if row[0] != bucket and held:
                yield answer(bucket, held)
                held = []
            bucket = row[0]
            held.append(row[1:])
    if held:
        yield answer(bucket, held)


def _judge(percent: int):
    """Sums the answers of a block; rows come sorted by block, its own row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, shared = None, None

        def emit():
            n, sampled, own = (np.array(head[c], dtype=np.int64) for c in ("n", "sampled", "own"))
            spare = n - -(-n * percent // 100)
            near = (n > 0) & (own + shared >= sampled - spare)
            columns = [head["id"], head["tag"], head["n"], head["d0"], head["d1"], near]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "tag", "n", "d0", "d1", "near"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["id"] is not None:
                    if head is not None:
                        yield emit()
                    head, shared = row, np.zeros(len(row["id"]), dtype=np.int64)
                else:
                    np.add.at(shared, np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["counts"], "<u4").astype(np.int64))
        if head is not None:
            yield emit()

    return run


def _ordered_sets(words: int, percent: int, codes: np.ndarray, counts: np.ndarray, shift: int):
    """Sets with their shingles, rarest first, and how many of them must be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            cells, heads = [], []
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP_BYTES, side="right")) - 1)
                for s in shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words):
                    code = (s >> np.uint64(shift)).astype(np.int64)
                    at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                    sampled = s < np.uint64(1 << 63)
                    known = (codes[at] == code) & sampled if len(codes) else np.zeros(len(s), bool)
                    # rare ones, then those that were not counted, then frequent ones by count
                    place = np.where(known, counts[at] if len(codes) else 0, np.where(sampled, 0, 1))
                    cells.append(s[np.lexsort((s, place))].tobytes())
                    heads.append(len(s) - -(-len(s) * percent // 100) + 1)
                low = high
            others = [batch.column(c) for c in ("d0", "d1", "n")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(heads, pa.int32()), pa.array(cells, pa.binary())], ["d0", "d1", "n", "head", "shingles"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("shingles"))
        head = np.asarray(batch.column("head"), dtype=np.int64)
        found = np.ascontiguousarray(data).view(np.int64)[spans(offsets[:-1] // 8, head)]
        sid = np.repeat(np.asarray(batch.column("sid")), head)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sid)], ["shingle", "sid"])


def _link_groups(percent: int):
    """Rows come sorted by (grp, piece)."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[2]: r for r in rows}.values())
        found = group_links([np.frombuffer(r[3], np.uint64) for r in rows], percent)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i, _ in found], pa.int64()), pa.array([rows[j][2] for _, j in found], pa.int64())], ["u", "v"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "piece", "sid", "shingles"))):
                if held and row[:2] != held[-1][:2]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    return run


def _joined(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of the groups in `members` (grp, piece, sid)."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(sets.select("sid", "shingles"), "sid").select("grp", "piece", "sid", "shingles")
    placed = rows.repartition(parts, "grp", "piece").sortWithinPartitions("grp", "piece")
    return placed.mapInArrow(_link_groups(percent), "u long, v long")


def set_edges(sets: DataFrame, percent: int = PERCENT, group_sets: int = GROUP_SETS) -> DataFrame:
    """Edges that connect exactly the components of the links between `sets` (sid, head, shingles)."""
    postings = sets.select("sid", "head", "shingles").mapInArrow(_postings, "shingle long, sid long")
    leaders = postings.groupBy("shingle").agg(F.min("sid").alias("grp"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    leaders = materialise(leaders, "leaders")  # as a table, so that Spark can split the join at a hot shingle
    members = materialise(postings.join(leaders, "shingle").select("grp", "sid").distinct(), "members")
    sizes = members.groupBy("grp").count().where(F.col("count") > 1)
    sizes = materialise(sizes.select("grp", F.ceil(F.col("count") / F.lit(group_sets)).cast("int").alias("pieces")), "sizes")
    placed = members.join(sizes, "grp")
    small = placed.where("pieces = 1").select("grp", F.lit(0).alias("piece"), "sid")
    large = placed.where("pieces > 1")
    piece = F.pmod(F.xxhash64("sid"), F.col("pieces")).cast("int")
    cut = large.select("grp", piece.alias("piece"), "sid")
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    with_leader = sizes.where("pieces > 1").select("grp", every.alias("piece"), F.col("grp").alias("sid"))
    edges = materialise(_joined(small.unionByName(cut).unionByName(with_leader), sets, percent), "links")
    if sizes.where("pieces > 1").isEmpty():
        return edges
    # what is outside the main component of a large group meets all of the group
    label = components(edges)
    known = large.join(label, F.col("sid") == F.col("node"), "left").select("grp", "pieces", "sid", F.coalesce("label", "sid").alias("label"))
    known = materialise(known, "known")
    count = known.groupBy("grp", "label").count()
    main = count.groupBy("grp").agg(F.max_by("label", "count").alias("main"))
    rest = known.join(main, "grp").where("label <> main").select("grp", "pieces", "sid")
    rest = materialise(rest, "rest")
    sets_left = rest.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_sets)).cast("int").alias("rows"))
    rest = rest.join(sets_left, "grp").withColumn("row", F.pmod(F.xxhash64("sid", F.lit(1)), "rows").cast("int"))
    cell = (F.col("row") * F.col("pieces") + F.col("column")).alias("piece")
    ours = rest.select("grp", "pieces", "sid", "row", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("column"))
    theirs = large.join(sets_left, "grp").select(
        "grp", "pieces", "sid", piece.alias("column"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")
    )
    again = ours.select("grp", cell, "sid").unionByName(theirs.select("grp", cell, "sid"))
    return edges.unionByName(materialise(_joined(again, sets, percent), "links"))


def one_per_component(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest doc_id stays."""
    docs = as_scan(docs)
    found = materialise(jaccard_components(docs, **settings).where("label IS NOT NULL"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    first = found.groupBy("label").agg(F.min(order).alias("f")).select(F.col("f.tag").alias("tag"), "label", F.lit(True).alias("stays"))
    # a tag stands for one row within its doc_id
    dropped = found.join(first, ["label", "tag"], "left").where("stays IS NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("tag").alias("_tag"))
    rows = located(docs).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_tag", F.xxhash64("_file", "_row"))
    return rows.join(dropped, ["_id", "_tag"], "left_anti").select(*docs.columns)


def _most_frequent(counts: DataFrame, most: int):
    """Shingles with the highest counts, `most` at the most, as a pandas table.

    A histogram over eighths of a doubling (a few hundred rows) tells from which count on they are few enough, so no
    more than `most` rows ever leave the executors."""
    step = F.floor(F.log2("df") * 8).cast("int")
    lowest, taken = None, 0
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        taken += row["count"]
        if taken > most:
            break
        lowest = row.step
    return counts.where(F.lit(False) if lowest is None else step >= lowest).toPandas()


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group_sets: int = GROUP_SETS, frequent: int = FREQUENT
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, tag, label.

    A text with fewer than `words` words is one shingle; without words, or null, it is empty and links
    with nothing.  component_id is the smallest doc_id that links reach; null ids aren't chosen
    unless there is no other.  Repeated rows link with each other.  Other columns don't matter;
    an empty table gives no rows.  `tag` tells rows with the same doc_id apart; `label` is equal within a
    component and null for rows that can't link.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = located(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("_file", "_row").alias("tag"), "text"
    )
    # a bucket holds the fingerprints of at most half a split, so its size doesn't grow with the data
    splits = source.rdd.getNumPartitions()
    buckets = 1 << max(4, (max(4 * parts, 2 * splits) - 1).bit_length())
    sketch = materialise(source.mapInArrow(_sketch(words, buckets), SKETCH), "sketch")
    bits = buckets.bit_length() - 1
    asked = sketch.where("kind = 1").select("bucket", "block", "prints", "docs", "more")
    answers = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count_bucket, ANSWER)
    answers = materialise(answers, "answers")
    often = _most_frequent(answers.where("shingle IS NOT NULL").select("shingle", "df"), frequent).sort_values("shingle")
    head = sketch.where("kind = 0").select("block", "id", "tag", "n", "sampled", "own", "d0", "d1", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("counts"))
    replies = answers.where("block IS NOT NULL").select("block", "docs", "counts")
    both = head.unionByName(replies, allowMissingColumns=True)
    judged = both.repartition(parts, "block").sortWithinPartitions("block", F.col("id").isNull())
    rows = materialise(judged.mapInArrow(_judge(percent), SETS), "judged")
    drop_stage(sketch)
    drop_stage(answers)
    release(spark)

    # any row of each distinct set stands for it
    distinct = rows.where("near").groupBy("d0", "d1", "n").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "tag")).alias("r"), F.min("id").alias("least"))
    distinct = materialise(distinct.select("d0", "d1", "n", F.col("r.id").alias("key"), F.col("r.tag").alias("tag"), "least"), "distinct")
    texts = source.withColumn("key", F.coalesce("id", F.lit(NO_ID))).drop("id").join(distinct.hint("merge").drop("least"), ["key", "tag"])
    order = _ordered_sets(words, percent, often["shingle"].to_numpy(np.int64), often["df"].to_numpy(np.int64), 31 - bits)
    sets = texts.mapInArrow(order, "d0 long, d1 long, n int, head int, shingles binary").withColumn("sid", F.monotonically_increasing_id())
    sets = materialise(sets, "sets")
    release(spark)
    label = components(set_edges(sets, percent, group_sets))
    release(spark)
    named = distinct.select("d0", "d1", "n", "least").join(sets.select("d0", "d1", "n", "sid"), ["d0", "d1", "n"])
    named = named.join(label, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(smallest, "label").select("d0", "d1", "n", "component", "label")
    component = F.when(F.col("near"), F.col("component")).otherwise(F.col("id"))
    return rows.join(named, ["d0", "d1", "n"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "tag",
        F.when(F.col("near"), F.col("label")).alias("label"),
    )
