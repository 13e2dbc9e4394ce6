import time

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources.topics import Topic, as_messages
from ledgerlake.streaming import progress
from ledgerlake.streaming.ingest import run


def publish(spark, topic, n, start=0):
    ids = spark.range(start, start + n).select(F.col("id").cast("string").alias("_id"))
    topic.publish(as_messages(ids, F.col("_id").cast("long")))


def start(spark, topic, path, seen, every=None, name="reader"):
    def handle(batch, batch_id):
        seen.append((batch_id, batch.count()))

    return run(progress.observed(topic.read_stream(spark)), handle, path("checkpoint"), name, every)


def test_reports_become_a_table(spark, path):
    topic, seen, told = Topic(path("topic")), [], path("told")
    publish(spark, topic, 30)
    with progress.recorded(spark, told):
        start(spark, topic, path, seen).awaitTermination()
        publish(spark, topic, 12, start=30)
        start(spark, topic, path, seen).awaitTermination()
    batches = progress.progress(spark, told)
    assert [tuple(r) for r in batches.where("input_rows > 0").orderBy("batch_id").select("query", "last_offset").collect()] == [
        ("reader", 29), ("reader", 41)
    ]
    row = progress.consumers(batches).first()
    assert (row["query"], row.batches, row.rows_taken, row.next_offset) == ("reader", 2, 42, 42) and row.busy_ms > 0
    state = progress.topic_state(topic.read(spark), batches).first()
    assert (state.published, state.processed) == (42, 42)


def test_no_reports_is_an_empty_table(spark, path):
    with progress.recorded(spark, path("told")):
        pass
    batches = progress.progress(spark, path("told"))
    assert batches.count() == 0 and progress.consumers(batches).count() == 0


def test_a_quiet_query_stops_and_goes_on(spark, path):
    topic, seen = Topic(path("topic")), []
    publish(spark, topic, 10)
    for n in (10, 5):
        query = start(spark, topic, path, seen, every="100 milliseconds")
        began = time.monotonic()
        progress.stop_when_quiet(query, 1.5)
        assert not query.isActive and time.monotonic() - began >= 1.5
        publish(spark, topic, 5, start=10)
    assert [n for _, n in seen] == [10, 5] and [b for b, _ in seen] == [0, 1]


def test_an_error_is_raised(spark, path):
    topic = Topic(path("topic"))
    publish(spark, topic, 3)

    def handle(batch, batch_id):
        raise RuntimeError("no room")

    query = run(topic.read_stream(spark), handle, path("checkpoint"), "failing", "100 milliseconds")
    with pytest.raises(Exception, match="no room"):
        progress.stop_when_quiet(query, 5)
