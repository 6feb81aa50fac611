"""Exact deduplication with a streaming, disk-backed state that never expires.

Only DataFrame and SQL functions.  Steps:

1. A narrow feed is staged: digest of the normalised text, stable identifier and content
   locator (file and row position) of every row.  Texts stay where they are.
2. A Structured Streaming aggregation reads the feed and keeps, for each digest, the
   smallest identifier with its locator and the number of rows.  State lies in RocksDB
   on the executors' disks with change logs in the shared folder; it has no watermark and
   so no expiry, and a later run on the same checkpoint goes on from it.  Copies are counted
   before the shuffle, so a digest that a third of the rows share sends a row per task.
3. State is read back as a table.  Rows that hit an earlier digest get their full
   normalised bytes compared with those of the row the state points at.  Both texts are
   fetched by locator (no key is hot there); for the comparison a large group is cut into
   salted pieces of HIT_ROWS rows.  Rows whose bytes differ in spite of an equal digest
   are grouped by their full text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from hybridq.plans.stages import materialise, stage_path

#: Rows of one group that are compared in one piece.
HIT_ROWS = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: no disk space in advance, logs of changes instead of whole snapshots
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: One space for each run of white space; a lone space needs no replacement.
RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def as_scan(docs: DataFrame) -> DataFrame:
    """`docs` itself if it is read from files row by row, else a staged copy."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return materialise(docs, "located")


def located(docs: DataFrame) -> DataFrame:
    """`docs` with _file and _row, its position in storage."""
    return as_scan(docs).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def dedup_state(feed: DataFrame) -> DataFrame:
    """The keyed aggregation, for a streaming or a static feed: digest -> first row, number of rows."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")
    return feed.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))


def run_stream(spark: SparkSession, feed_path: str, schema, checkpoint: str, bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """Bring the state in `checkpoint` up to date with the files in `feed_path`; returns the state as a table."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(feed_path)
        sink = dedup_state(stream).writeStream.outputMode("update").format("noop")
        sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    first, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{first}").alias("first"), F.col(f"value.{n}").alias("n"))


def exact_dedup(docs: DataFrame, digest=None, bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, _file, _row.

    Texts are equal when their normalised forms are.  Null counts as empty.  The smallest doc_id
    stays; a null doc_id comes after all others; of rows with the same text and doc_id the
    first in storage stays, so exactly one row of each group has `kept`.  Other columns of
    `docs` don't matter.  An empty table gives no rows.  `digest` (Column -> binary Column)
    replaces SHA-256 as the state's key; a weak one costs time, never correctness.
    """
    spark = docs.sparkSession
    source = located(docs.select("doc_id", "text"))
    sha = F.sha2(normalised(F.col("text")), 256)
    key = F.unhex(sha) if digest is None else digest(normalised(F.col("text")))
    feed_path = stage_path(spark, "feed")
    feed = source.select("doc_id", "_file", "_row", sha.alias("text_sha256"), key.alias("digest"))
    schema = feed.schema
    feed.write.parquet(feed_path)
    feed = spark.read.schema(schema).parquet(feed_path)
    state = run_stream(spark, feed_path, schema, stage_path(spark, "dedup-state"), bytes_per_trigger)

    shared = state.where("n > 1")
    hits = materialise(
        feed.join(shared, "digest").select(
            "digest", "doc_id", "_file", "_row", "n", "first",
            ((F.col("_file") == F.col("first._file")) & (F.col("_row") == F.col("first._row"))).alias("is_first"),
        ),
        "hits",
    )
    pieces = F.ceil(F.col("n") / F.lit(HIT_ROWS))
    # texts are fetched by position, with one plan at every size
    texts = source.select("_file", "_row", "text").join(hits.drop("doc_id", "first").hint("merge"), ["_file", "_row"])
    texts = texts.select("digest", "_file", "_row", "is_first", pieces.alias("pieces"), normalised(F.col("text")).alias("norm"))
    members = texts.where("NOT is_first").withColumn("piece", F.pmod(F.xxhash64("_file", "_row"), "pieces").cast("int"))
    firsts = texts.where("is_first").select(
        "digest", F.explode(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int"))).alias("piece"), F.col("norm").alias("first_norm")
    )
    differing = materialise(
        members.join(firsts, ["digest", "piece"]).where("norm <> first_norm").select("digest", "_file", "_row", "norm"), "differing"
    )
    rows = feed.join(hits.select("_file", "_row", "first", "n"), ["_file", "_row"], "left")
    keep_id, size = F.coalesce(F.col("first.doc_id"), F.col("doc_id")), F.coalesce(F.col("n"), F.lit(1).cast("long"))
    is_first = F.col("n").isNull() | ((F.col("_file") == F.col("first._file")) & (F.col("_row") == F.col("first._row")))
    columns = ["doc_id", keep_id.alias("keep_id"), size.alias("group_size"), is_first.alias("kept"), "text_sha256", "_file", "_row"]
    if differing.isEmpty():
        return rows.select(*columns)
    # equal digests of different texts: those rows form groups of their own
    apart = differing.join(feed, ["_file", "_row", "digest"]).groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")).alias("own_first"),
        F.count(F.lit(1)).alias("own_n"),
    )
    lost = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    own = differing.join(apart, ["digest", "norm"]).select("_file", "_row", "own_first", "own_n")
    return (
        rows.join(own, ["_file", "_row"], "left")
        .join(lost, "digest", "left")
        .withColumn("first", F.coalesce("own_first", "first"))
        .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))))
        .select(*columns)
    )


def distinct_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, unchanged."""
    docs = as_scan(docs)
    rows = located(docs)
    copies = exact_dedup(docs, **settings).where("NOT kept").select("_file", "_row")
    return rows.join(copies.hint("merge"), ["_file", "_row"], "left_anti").select(*docs.columns)
