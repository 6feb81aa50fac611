"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from dataclasses import dataclass
from threading import Condition

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from hybridq.operators.conversations import fold_search_state, title_from_text
from hybridq.operators.documents import chunk_documents
from hybridq.operators.embedding import with_vectors
from hybridq.operators.traces import trace_metrics


@dataclass
class RunReport:
    """What the batches of a run said: how many there were, rows read, and rows too late for a watermark."""

    batches: int = 0
    rows: int = 0
    late_rows: int = 0
    complete: bool = False  # whether the last event of the run was seen


class Progress(StreamingQueryListener):
    """Sums the progress events of each run.  A run's events may come before its caller knows its id."""

    def __init__(self):
        self.runs: dict[str, RunReport] = {}
        self.news = Condition()

    def _of(self, run) -> RunReport:
        return self.runs.setdefault(str(run), RunReport())

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        with self.news:
            report = self._of(p.runId)
            report.batches += 1
            report.rows += p.numInputRows
            report.late_rows += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.news:
            self._of(event.runId).complete = True
            self.news.notify_all()

    def report(self, run, seconds: float = 60) -> RunReport:
        """Events come on a thread of their own, so the last of a run is waited for."""
        with self.news:
            self.news.wait_for(lambda: self._of(run).complete, seconds)
            return self._of(run)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> RunReport:
    """Process everything that is there now, then stop; restarts from `checkpoint`.

    The report counts the rows that a watermark left out, so that none is lost unseen.  Where a query has several
    stateful steps, a row is counted by the step that leaves it out."""
    streams, progress = stream.sparkSession.streams, Progress()
    streams.addListener(progress)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(sink).start()
        )
        query.awaitTermination()
        return progress.report(query.runId)
    finally:
        streams.removeListener(progress)


def stream_index(documents: DataFrame, path: str, checkpoint: str, max_chars: int = 900, dims: int = 1024) -> None:
    """New documents -> chunks -> vectors, appended under `path` by batch.

    A batch writes its own directory, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_documents(batch, max_chars)
        with_vectors(chunks, "text", dims).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(documents, write, checkpoint)


def stream_conversation_summary(messages: DataFrame) -> DataFrame:
    """Running count, first and last activity and first user title per conversation (update mode)."""
    user = F.col("role") == "USER"
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.min_by(F.when(user, title_from_text(F.col("text"))), F.when(user, F.col("message_id"))).alias("title"),
    )


def stream_search_state(events: DataFrame, query_chars: int | None = None) -> DataFrame:
    """fold_search_state over a stream (update mode): one search and one focus per conversation, kept in the JVM."""
    return fold_search_state(events, query_chars)


def stream_feedback(ratings: DataFrame, delay: str) -> DataFrame:
    """Latest valid rating per message, repeated events dropped (update mode); `run_available` counts late ratings.

    Events repeated more than `delay` after each other may count twice; the latest rating is the same."""
    valid = ratings.where(F.col("rating").isNull() | F.col("rating").isin("up", "down"))
    once = valid.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("message_id").agg(
        F.max_by(F.struct("rating"), F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("rated_at")
    ).select("message_id", F.col("last.rating").alias("rating"), "rated_at")


def stream_trace_metrics(traces: DataFrame, delay: str, width: str = "5 minutes") -> DataFrame:
    """trace_metrics over a stream; rows more than `delay` behind the newest are dropped, so the caller must name it.

    `run_available` reports how many were."""
    return trace_metrics(traces.withWatermark("at", delay), width)
