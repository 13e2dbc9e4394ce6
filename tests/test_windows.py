import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.sources.files import write_parquet
from ledgerlake.sources.topics import Topic, as_messages
from ledgerlake.stream_queries import category_hours
from ledgerlake.streaming import windows

SCHEMA = "_id long, category string, amount double, time timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


class Stream:
    """A stream of files, run to its end after each batch of rows."""

    def __init__(self, spark, path, transform=category_hours, schema=SCHEMA):
        self.spark, self.transform, self.schema = spark, transform, schema
        self.source, self.target, self.checkpoint = path("source"), path("target"), path("checkpoint")
        self.n = 0

    def take(self, data):
        self.n += 1
        write_parquet(self.spark.createDataFrame(data, self.schema).coalesce(1), f"{self.source}/{self.n}")
        made = self.transform(windows.stream_files(self.spark, self.source, self.spark.createDataFrame([], self.schema).schema))
        query = windows.closed_windows(made, self.target, self.checkpoint, "test")
        query.awaitTermination()
        return [p for p in query.recentProgress if p["numInputRows"] or p["stateOperators"]]

    def closed(self):
        made = self.transform(self.spark.createDataFrame([], self.schema))
        return self.spark.read.schema(made.schema).parquet(self.target)


def test_closed_windows_equal_the_batch_and_late_rows_are_counted(spark, path):
    stream = Stream(spark, path)
    first = [(i, "ab"[i % 2], 1.5, at(i / 4)) for i in range(100)]
    second = [(200 + i, "a", 2.0, at(25 + i)) for i in range(60)] + [(300, None, None, at(40)), (301, "a", 1.0, None)]
    third = [(400, "a", 9.0, at(2)), (401, "a", 9.0, at(2)), (402, "b", 9.0, at(3)), (403, "a", 1.0, at(90))]
    stream.take(first)
    stream.take(second)
    reports = stream.take(third)
    # the three late rows are two rows by window and category when they meet the state
    assert sum(s["numRowsDroppedByWatermark"] for p in reports for s in p["stateOperators"]) == 2
    in_time = spark.createDataFrame(first + second + third[3:], SCHEMA)
    want = category_hours(in_time).where(F.col("window_end") <= F.lit(at(90 - 24)))
    assert rows(stream.closed()) == rows(want)
    assert spark.read.parquet(stream.target).where("category is null").count() == 1


def test_state_holds_open_windows_only(spark, path):
    stream = Stream(spark, path)
    held = []
    for day in range(6):
        reports = stream.take([(i, "a", 1.0, at(24 * day + i / 10)) for i in range(240)])
        held.append(reports[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 50 and held[-1] <= held[1] + 1


def test_an_empty_batch_and_restart(spark, path):
    stream = Stream(spark, path)
    stream.take([])
    stream.take([(1, "a", 1.0, at(0)), (2, "a", 1.0, at(50))])
    before = rows(stream.closed())
    stream.take([])
    assert rows(stream.closed()) == before and len(before) == 1


def test_sessions(spark, path):
    stream = Stream(
        spark, path, lambda r: windows.sessions(r, "time", ["category"], [F.count("*").alias("n")], "2 hours", "4 hours")
    )
    stream.take([(1, "a", 0.0, at(0)), (2, "a", 0.0, at(1.5)), (3, "b", 0.0, at(2)), (4, "a", 0.0, at(3.6))])
    stream.take([(5, "a", 0.0, at(4)), (6, "a", 0.0, at(6.5)), (8, "b", 0.0, at(6)), (9, "b", 0.0, at(8)), (7, "z", 0.0, at(30))])
    got = [(r.category, r.n, r.window_end) for r in stream.closed().collect()]
    assert sorted(got) == [("a", 1, at(8.5)), ("a", 2, at(3.5)), ("a", 2, at(6)), ("b", 1, at(4)), ("b", 2, at(10))]


def test_messages_are_taken_once_within_the_horizon(spark, path):
    def messages(ids, hour, value="v"):
        made = spark.createDataFrame([(None if i is None else str(i), f"{value}{i}") for i in ids], "_id string, x string")
        told = as_messages(made, F.lit(0))
        return told.withColumn("timestamp", F.lit(at(hour)))

    topic, taken, checkpoint = Topic(path("topic")), path("taken"), path("checkpoint")
    reports = []

    def drain():
        stream = windows.taken_once(topic.read_stream(spark), "2 hours")
        query = windows.closed_windows(stream.select("key", "value"), taken, checkpoint, "once")
        query.awaitTermination()
        reports.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    topic.publish(messages([1, 1, 2, None], 0).unionByName(messages([2], 0, "changed")))
    drain()
    topic.publish(messages([1, 2, None, 3], 1))
    drain()
    assert spark.read.parquet(taken).count() == 5  # 1, 2, 2 changed, the one without a key, 3
    for hour in range(4, 40, 4):
        topic.publish(messages(range(100 * hour, 100 * hour + 50), hour))
        drain()
    assert spark.read.parquet(taken).count() == 5 + 9 * 50
    assert max(reports) <= 110 and reports[-1] <= 110
