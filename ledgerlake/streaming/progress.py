"""What running queries report: their progress as a table, and a stop after a quiet time."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.files import read_parquet_or_empty
from ..schemas import PROGRESS

#: The parts of a progress report that the metrics need. An offset stays text: its form is the source's.
REPORT = """
    timestamp string, numInputRows bigint, durationMs map<string, bigint>,
    eventTime map<string, string>,
    stateOperators array<struct<numRowsTotal: bigint, numRowsDroppedByWatermark: bigint>>,
    sources array<struct<description: string, endOffset: string, numInputRows: bigint>>,
    observedMetrics map<string, struct<rows: bigint, last_offset: bigint>>
"""
#: The name under which a consumer observes the records it has taken.
TAKEN = "taken"


def observed(records: DataFrame) -> DataFrame:
    """Topic records; each batch's progress tells how many were taken and the last offset."""
    return records.observe(
        TAKEN, F.count(F.lit(1)).alias("rows"), F.max("offset").cast("bigint").alias("last_offset")
    )


class _Reports(StreamingQueryListener):
    """Keeps the reports of all queries of the session until they are stored."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, str]] = []
        self.running: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.running.add(str(event.runId))
            self.changed.notify_all()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.changed:
            self.rows.append((p.name or str(p.id), str(p.runId), p.batchId, p.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.running.discard(str(event.runId))
            self.changed.notify_all()

    def settled(self, seconds: float) -> bool:
        """Wait for the reports of queries that have stopped; they arrive a little later."""
        with self.changed:
            return self.changed.wait_for(lambda: not self.running, seconds)


@contextmanager
def recorded(spark: SparkSession, path: str, wait: float = 30.0) -> Iterator[None]:
    """Store the progress of all queries that run within, a row for each batch.

    Rows are few (one per batch), and are appended in one write at the end.
    """
    reports = _Reports()
    spark.streams.addListener(reports)
    try:
        yield
    finally:
        reports.settled(wait)
        spark.streams.removeListener(reports)
        with reports.changed:
            rows = list(reports.rows)
        if rows:
            spark.createDataFrame(rows, PROGRESS).write.mode("append").parquet(path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: rows in, milliseconds, state, rows too late, and the offset reached."""
    told = read_parquet_or_empty(spark, path, PROGRESS).withColumn("p", F.from_json("progress", REPORT))
    states = F.coalesce("p.stateOperators", F.array())

    def total(field: str):
        return F.aggregate(F.transform(states, lambda s: s[field]), F.lit(0).cast("bigint"), lambda a, b: a + b)

    return told.select(
        "query", "run_id", "batch_id", F.to_timestamp("p.timestamp").alias("at"),
        F.col("p.numInputRows").alias("input_rows"),
        F.col("p.durationMs")["triggerExecution"].alias("batch_ms"),
        total("numRowsTotal").alias("state_rows"),
        total("numRowsDroppedByWatermark").alias("late_rows"),
        F.col("p.eventTime")["watermark"].alias("watermark"),
        F.get("p.sources", 0)["endOffset"].alias("end_offset"),
        F.col("p.observedMetrics")[TAKEN]["last_offset"].alias("last_offset"),
    )


def consumers(batches: DataFrame) -> DataFrame:
    """Per query: batches, rows taken, the next offset to take and the time spent."""
    return batches.groupBy("query").agg(
        F.count_if(F.col("input_rows") > 0).alias("batches"),
        F.sum("input_rows").alias("rows_taken"),
        (F.coalesce(F.max("last_offset"), F.lit(-1)) + 1).alias("next_offset"),
        F.sum("batch_ms").alias("busy_ms"),
    )


def topic_state(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Messages published to a topic, and processed by the slowest of its consumers.

    ``records`` are the topic's; of a broker its end offsets serve as well.
    """
    published = records.agg((F.coalesce(F.max("offset"), F.lit(-1)) + 1).alias("published"))
    processed = consumers(batches).agg(F.min("next_offset").alias("processed"))
    return published.crossJoin(processed)  # one row each


class _Activity(StreamingQueryListener):
    """When a query last took messages, as its own reports tell."""

    def __init__(self, run_id: str) -> None:
        self.run_id, self.last, self.idle = run_id, time.monotonic(), False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run_id and event.progress.numInputRows:
            self.last, self.idle = time.monotonic(), False

    def onQueryIdle(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.idle = True

    def onQueryTerminated(self, event) -> None:
        pass


def stop_when_quiet(query: StreamingQuery, seconds: float) -> None:
    """Wait until a continuous query has had no message for ``seconds``, then stop it.

    It is stopped only after it has reported that it is idle, so no batch is cut short; one
    that begins at that moment is repeated at the next start under its own id. An error of the
    query is raised here.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    activity = _Activity(str(query.runId))
    spark.streams.addListener(activity)
    try:
        while not query.awaitTermination(max(1, min(int(seconds), 5)) if seconds >= 1 else 1):
            quiet = time.monotonic() - activity.last
            if activity.idle and quiet >= seconds and not query.status["isTriggerActive"]:
                query.stop()
                return
    finally:
        spark.streams.removeListener(activity)
