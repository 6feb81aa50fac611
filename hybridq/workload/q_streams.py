"""Streaming queries: each replays whole tables as several files and returns the final state."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from hybridq.streaming import streams as S
from hybridq.workload import q_answers, q_conversations as V
from hybridq.workload.duck import with_ctes
from hybridq.workload.q_sources import scratch
from hybridq.workload.registry import ORACLE, query
from hybridq.workload.tables import VECTOR_SUM, vector_sums, view

c = F.col
# replayed files may arrive in any order, so nothing inside the month counts as late
WHOLE_MONTH = "40 days"


def replay(df, path: str, order: str | None = None, files: int = 4):
    """Write `df` as files and read it back as a stream, one file per batch."""
    if order:
        df = df.repartitionByRange(files, order).sortWithinPartitions(order)
    else:
        df = df.repartition(files)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def last_rows(stream, path: str, key: list[str], mode: str = "update"):
    """Run to completion and return the last emitted row per key."""

    def keep(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/b={batch_id}")

    S.run_available(stream, keep, f"{path}/checkpoint", mode)
    out = stream.sparkSession.read.parquet(f"{path}/out")
    newest = Window.partitionBy(*key).orderBy(F.col("_batch").desc())
    return out.withColumn("_n", F.row_number().over(newest)).where(c("_n") == 1).drop("_n", "_batch", "b")


@query(
    "stream_index",
    with_ctes(
        f"""SELECT c.document_id, c.text, coalesce(v.entries, 0) AS entries, coalesce(v.vector_sum, 0) AS vector_sum FROM document_chunks c
        LEFT JOIN (SELECT k, {VECTOR_SUM} FROM ce GROUP BY k) v ON v.k = c.document_id""",
        "document_chunks", "ce",
    ),
)
def stream_index(spark, sf):
    path = scratch(spark)
    docs = replay(view(spark, sf, "documents").select("doc_id", "text"), f"{path}/in")
    S.stream_index(docs, f"{path}/index", f"{path}/checkpoint")
    index = spark.read.parquet(f"{path}/index")
    return index.select("document_id", "text").join(vector_sums(index), "document_id")


@query("stream_conversation_summary", ORACLE["conversation_summary"])
def stream_summary(spark, sf):
    path = scratch(spark)
    stream = S.stream_conversation_summary(replay(V.messages(spark, sf), f"{path}/in"))
    out = last_rows(stream, path, ["conv_id"])
    return out.select(
        "conv_id", F.coalesce("title", F.lit("New chat")).alias("title"), V.at("created_at"), V.at("updated_at"), "messages"
    )


@query("stream_search_state", ORACLE["fold_search_state"])
def stream_state(spark, sf):
    path = scratch(spark)
    stream = S.stream_search_state(replay(V.state_events(spark, sf), f"{path}/in"))
    out = last_rows(stream, path, ["conv_id"])
    return out.select("conv_id", "criteria", "query", V.flat("candidate_ids"), V.flat("shown_ids"), "focus_id")


@query(
    "stream_feedback",
    with_ctes(
        """SELECT message_id, rating FROM ratings WHERE rating IS NULL OR rating IN ('up', 'down') QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, event_id DESC) = 1""",
        "ratings",
    ),
)
def stream_feedback(spark, sf):
    path = scratch(spark)
    rows = view(spark, sf, "ratings").withColumn("ts", c("ts").cast("timestamp"))
    stream = S.stream_feedback(replay(rows.unionByName(rows), f"{path}/in", "ts"), WHOLE_MONTH)
    return last_rows(stream, path, ["message_id"]).select("message_id", "rating")


@query("stream_trace_metrics", ORACLE["trace_metrics"])
def stream_metrics(spark, sf):
    path = scratch(spark)
    rows = q_answers.traces(spark, sf).withColumn("at", c("at").cast("timestamp"))
    stream = S.stream_trace_metrics(replay(rows, f"{path}/in", "at"), delay=WHOLE_MONTH)
    return q_answers.flat_metrics(last_rows(stream, path, ["window_start", "intent"]))


