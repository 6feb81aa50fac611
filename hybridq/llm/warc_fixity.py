"""Fixity audit of web archives by Merkle trees.

Pages become WARC records, laid out in files in page order with their offsets.  Each record is hashed;
a node hashes up to FAN children with their offset ranges, level by level to one root per
file.  Two replicas are compared from the roots down: a level is only joined below nodes that
differ, so sound files cost one comparison and damage is found in
log(records) steps.

Only DataFrame functions.  A level has 1/FAN of the rows below it and groups of FAN rows.
Files are bounded: FILE_RECORDS page numbers each, cut into pieces by content
where ids repeat too often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq.plans.stages import materialise

FILE_RECORDS = 512
FAN = 16
END = "\r\n\r\n"


def record_text(url: Column, html: Column) -> Column:
    """A WARC resource record without the two line ends behind it."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    h = F.md5(F.concat(url, F.lit("\n"), html))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]),
        F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html,
    )


def archive(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """page_id, file, piece, seq, offset, length, record for every row of `pages` (page_id, url, html).

    Null url or html count as empty; null page_ids come in file -1.  Repeated rows are records of their
    own.  Other columns don't matter; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html", record_text(F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / F.lit(file_records)), F.lit(-1)).cast("long"))
    sizes = rows.groupBy("file").count().where(F.col("count") > 4 * file_records)
    pieces = sizes.select("file", F.ceil(F.col("count") / F.lit(4 * file_records)).cast("int").alias("pieces"))
    rows = rows.join(pieces, "file", "left").withColumn(
        "piece", F.pmod(F.xxhash64("url", "html", "page_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    )
    size = F.octet_length("record") + len(END)
    order = Window.partitionBy("file", "piece").orderBy("page_id", "url", "html")
    return rows.select(
        "page_id", "file", "piece", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("long").alias("offset"),
        size.cast("long").alias("length"), "record",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Real WARC files: a folder per file and piece, records in order."""
    ordered = records.repartition("file", "piece").sortWithinPartitions("file", "piece", "seq")
    ordered.select("file", "piece", "record").write.partitionBy("file", "piece").option("lineSep", END).text(path)


def leaves(records: DataFrame) -> DataFrame:
    """The lowest level of a replica's tree: a hash for each record (file, piece, seq, offset, length, record)."""
    return records.select(
        "file", "piece", F.col("seq").alias("idx"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"),
        F.sha2(F.concat("record", F.lit(END)), 256).alias("hash"),
    )


def tree(bottom: DataFrame, levels: int, fan: int = FAN) -> list[DataFrame]:
    """The levels from the leaves to the roots: file, piece, idx, low, high, hash."""
    out = [bottom]
    for _ in range(levels):
        child = F.struct("idx", "low", "high", "hash")
        grouped = out[-1].groupBy("file", "piece", F.floor(F.col("idx") / F.lit(fan)).cast("long").alias("up")).agg(
            F.sort_array(F.collect_list(child)).alias("c")
        )
        text = F.transform("c", lambda x: F.concat_ws(":", x.idx.cast("string"), x.low.cast("string"), x.high.cast("string"), x.hash))
        out.append(
            grouped.select(
                "file", "piece", F.col("up").alias("idx"), F.col("c")[0]["low"].alias("low"),
                F.element_at("c", -1)["high"].alias("high"), F.sha2(F.array_join(text, ","), 256).alias("hash"),
            )
        )
    return out


def audit(ours: DataFrame, theirs: DataFrame, fan: int = FAN, least_levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """(differing leaves: file, piece, idx, status; roots of `ours`) of two leaf tables.

    status is corrupt, missing (not in `theirs`) or extra (not in `ours`).  Trees have `least_levels`
    levels above the leaves, or more where a file needs them, so that roots of all runs compare.
    """
    top = max(df.agg(F.max("idx")).head()[0] or 0 for df in (ours, theirs))
    levels = least_levels
    while fan**levels <= top:
        levels += 1
    pair = [[materialise(x, f"level{k}") if 0 < k else x for k, x in enumerate(tree(df, levels, fan))] for df in (ours, theirs)]
    key, suspects = ["file", "piece", "idx"], None
    for a, b in zip(reversed(pair[0]), reversed(pair[1])):
        if suspects is not None:
            below = [F.col("file"), F.col("piece"), F.floor(F.col("idx") / F.lit(fan)).cast("long").alias("up")]
            wanted = suspects.select("file", "piece", F.col("idx").alias("up"))
            a, b = (x.select("*", below[2]).join(wanted, ["file", "piece", "up"], "left_semi").drop("up") for x in (a, b))
        mine = a.select(*key, "low", "high", F.col("hash").alias("mine"))
        other = b.select(*key, F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("hash").alias("other"))
        both = mine.join(other, key, "full_outer")
        differs = ~(F.col("mine").eqNullSafe(F.col("other")) & F.col("low").eqNullSafe(F.col("low2")) & F.col("high").eqNullSafe(F.col("high2")))
        status = F.when(F.col("other").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("corrupt")
        suspects = materialise(both.where(differs).select(*key, status.alias("status")), "suspects")
    return suspects, pair[0][-1]
