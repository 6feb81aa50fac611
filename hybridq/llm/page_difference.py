"""Main text of pages by differencing each page with the one whose URL is nearest on its host.

1. Every page becomes lines (see page_lines); what leaves a task is a hash and a length of each line.
2. Equal pages of a host count once.  Pages are range-partitioned by host, path and content and
   numbered, so that neighbours in this order meet by an equi-join on their numbers: a host with a third
   of all pages spreads over all tasks, and no page meets more than two others.
3. The lines of two neighbours are aligned by a longest common subsequence (bit-parallel, in halves
   where the table would be large).  Shared lines are template, unless the pages share three quarters
   of their unmarked text: those are near copies of each other and say nothing.  Of its two neighbours a page takes the one
   that is no near copy, then the one with the longer common path.
4. The pages are read again; shared lines go.  So does what the markup calls furniture (navigation,
   adverts, comments, ...), since two neighbours need not share it, and a host may have one page only.
   Text in an article (else in a main element) stays even if shared: a repeated
   paragraph is text, and the contract drops nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hybridq.llm.arrow import by_bytes
from hybridq.llm.exact_dedup import as_scan
from hybridq.llm.page_lines import ARTICLE, FURNITURE, MAIN, OPEN, page_lines
from hybridq.plans.joins import spread_join
from hybridq.plans.stages import drop_stage, materialise

#: Two pages that share this part of their text outside furniture are near copies.
NEAR_COPY = 0.75
#: Bits of the table of an alignment that are held at once.
TABLE_BITS = 1 << 28
#: Host and path of an absolute URL; the query and the fragment don't count.
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
OUTLINE = "file long, row long, host string, path string, content binary, lines binary, kinds binary, lengths array<int>"
MASKS = "file long, row long, n_shared long, gone array<boolean>"


# ---------------------------------------------------------------------------
# Longest common subsequence
# ---------------------------------------------------------------------------
def _rows(a: list, b: list):
    """Bit rows of the alignment of each prefix of `a` with `b`; a zero bit is a step of the common length."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def common_lines(a: list, b: list, table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, ascending."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < min(len(a), len(b)) - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(low)]
    out += [(low + i, low + j) for i, j in _aligned(a[low : len(a) - tail], b[low : len(b) - tail], table_bits)]
    return out + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]


def _aligned(a: list, b: list, table_bits: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > table_bits and len(a) > 1:
        # split `a` in half and `b` where both halves align best
        half = len(a) // 2
        for front in _rows(a[:half], b):
            pass
        for rear in _rows(a[half:][::-1], b[::-1]):
            pass
        steps = lambda row: np.concatenate([[0], np.cumsum(_zeros(row, len(b)))])
        cut = int(np.argmax(steps(front) + steps(rear)[::-1]))
        left = _aligned(a[:half], b[:cut], table_bits)
        return left + [(half + i, cut + j) for i, j in _aligned(a[half:], b[cut:], table_bits)]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


def _zeros(row: int, size: int) -> np.ndarray:
    raw = np.frombuffer(row.to_bytes(size // 8 + 1, "little"), dtype=np.uint8)
    return 1 - np.unpackbits(raw, bitorder="little")[:size].astype(np.int64)


# ---------------------------------------------------------------------------
# Pages as outlines, neighbours, shared lines
# ---------------------------------------------------------------------------
def main_kind(kinds) -> int:
    """The part of the page that has its text: articles, else main elements, else what is unmarked."""
    return ARTICLE if ARTICLE in kinds else MAIN if MAIN in kinds else OPEN


def _line_hashes(lines: list[str]) -> bytes:
    return b"".join(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest() for x in lines)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds_of = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
    names = ["file", "row", "host", "path", "content", "lines", "kinds", "lengths"]
    for batch in by_bytes(batches, "html"):
        out = []
        for file, row, host, path, html in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "host", "path", "html"))):
            lines, kinds = page_lines(html or "")
            if lines:
                hashes = _line_hashes(lines)
                content = hashlib.blake2b(hashes + bytes(kinds), digest_size=16).digest()
                out.append((file, row, host, path, content, hashes, bytes(kinds), [len(x) for x in lines]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds_of)], names)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(batch.num_rows, part, dtype=np.int64)), place, *batch.columns], ["part", "at", *batch.schema.names]
        )


def nearness(a: str, b: str) -> int:
    """How many leading segments two paths share."""
    n = 0
    for x, y in zip(a.strip("/").split("/"), b.strip("/").split("/")):
        if x != y:
            break
        n += 1
    return n


SHARED = "host string, content binary, copy boolean, near int, follows boolean, shared binary"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both pages of a pair: whether they are near copies, how near they are, and their shared lines as a mask."""
    kinds_of = [pa.string(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["host", "content", "copy", "near", "follows", "shared"]
    columns = ["host"] + [f"{side}_{c}" for side in "ab" for c in ("path", "content", "lines", "kinds", "lengths")]
    for batch in batches:
        out = []
        for host, *pages in zip(*(batch.column(c).to_pylist() for c in columns)):
            (path, content, lines, kinds, lengths), (path_b, content_b, lines_b, kinds_b, lengths_b) = pages[:5], pages[5:]
            pairs = common_lines(*(np.frombuffer(x, dtype=np.int64).tolist() for x in (lines, lines_b)))
            text = [sum(n for n, k in zip(ns, ks) if k != FURNITURE) for ns, ks in ((lengths, kinds), (lengths_b, kinds_b))]
            same = sum(lengths[i] for i, j in pairs if kinds[i] != FURNITURE and kinds_b[j] != FURNITURE)
            copy = same > 0 and same >= NEAR_COPY * min(text)
            near = nearness(path, path_b)
            for follows, own, n, places in ((False, content, len(kinds), [i for i, _ in pairs]), (True, content_b, len(kinds_b), [j for _, j in pairs])):
                mask = np.zeros(n, dtype=np.uint8)
                mask[places] = 1
                out.append((host, own, copy, near, follows, mask.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds_of)], names)


def _numbers(outlines: DataFrame) -> DataFrame:
    """One page for each content of a host, in order, numbered within its range."""
    pages = outlines.groupBy("host", "content").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("lines", "kinds", "lengths")])
    order = ["host", "path", "content"]
    placed = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInArrow(_numbered, f"part long, at long, {ddl}")


def _neighbours(numbered: DataFrame) -> DataFrame:
    """(host, content, mask of the lines shared with the nearest page that is no near copy), for pages that share any."""
    # one row for each range
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = numbered.join(F.broadcast(base), "part").withColumn("at", F.col("at") + F.col("base")).drop("part", "base")
    side = lambda s: numbered.select(*[F.col(c).alias(f"{s}_{c}") for c in numbered.columns])
    next_ = side("b").withColumn("b_at", F.col("b_at") - 1)
    pairs = side("a").join(next_, F.col("a_at") == F.col("b_at")).where("a_host = b_host").withColumnRenamed("a_host", "host")
    found = pairs.select("host", *[f"{s}_{c}" for s in "ab" for c in ("path", "content", "lines", "kinds", "lengths")]).mapInArrow(_shared, SHARED)
    # a page has two neighbours at most
    best = F.max_by(F.struct("copy", "shared"), F.struct(~F.col("copy"), "near", "follows")).alias("best")
    chosen = found.groupBy("host", "content").agg(best).where("NOT best.copy")
    return chosen.select("host", "content", F.col("best.shared").alias("shared")).where(F.instr(F.hex("shared"), F.lit("01")) > 0)


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------
TEXTS = "page_id long, url string, file long, row long, text string, lines array<string>, kinds binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of pages whose markup says where it stands; the unmarked lines of the others."""
    kinds_of = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary()]
    names = ["page_id", "url", "file", "row", "text", "lines", "kinds"]
    for batch in by_bytes(batches, "html"):
        out = []
        for page, url, file, row, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "file", "row", "html"))):
            lines, kinds = page_lines(html or "")
            best = main_kind(kinds)
            text = [x for x, k in zip(lines, kinds) if k == best]
            marked = best != OPEN or not text
            out.append((page, url, file, row, " ".join(text) if marked else None, None if marked else text, bytes(kinds)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds_of)], names)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pages with shared lines outside their text: how many, and which of the unmarked lines are shared."""
    kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.bool_())]
    for batch in batches:
        out = []
        for file, row, kinds, shared in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "kinds", "shared"))):
            k, s = np.frombuffer(kinds, dtype=np.uint8), np.frombuffer(shared, dtype=np.uint8) > 0
            best = main_kind(kinds)
            gone = s & ((k != best) | (best == OPEN))
            out.append((file, row, int(gone.sum()), s[k == OPEN].tolist() if best == OPEN else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds_of)], ["file", "row", "n_shared", "gone"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared of every row of `pages` (page_id, url, html).

    n_shared counts the lines that went because the nearest page of the host has them too.  Null and
    empty pages, and pages without text outside furniture, have an empty text.  A null or odd URL counts as a
    host of its own kind (empty host, empty path).  Repeated rows and equal pages get equal texts; a null page_id
    is kept; ties between equally near neighbours go to the one before; an empty table gives no rows.  Other
    columns are ignored.
    """
    url = F.coalesce("url", F.lit(""))
    # the place of a row in storage names it in both readings
    rows = as_scan(pages).select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    outlines = materialise(rows.select("file", "row", "host", "path", "html").mapInArrow(_outlines, OUTLINE), "outlines")
    numbered = materialise(_numbers(outlines), "numbered")
    masks = _neighbours(numbered)
    own = spread_join(outlines.select("file", "row", "host", "content", "kinds"), masks, ["host", "content"], ["file", "row"])
    gone = materialise(own.select("file", "row", "kinds", "shared").mapInArrow(_masks, MASKS).where("n_shared > 0"), "gone")
    for stage in (outlines, numbered):
        drop_stage(stage)
    texts = rows.select("page_id", "url", "file", "row", "html").mapInArrow(_texts, TEXTS).join(gone, ["file", "row"], "left")
    left = F.filter(F.arrays_zip("lines", "gone"), lambda x: ~x["gone"])
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda x: x["lines"]))
    text = F.coalesce("text", F.array_join(left, " "))
    return texts.select(
        "page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
    )
