import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.plans import monitor
from ledgerlake.sources import documents
from ledgerlake.sources.topics import Topic


@pytest.fixture
def docs(spark, path):
    spark.createDataFrame(
        [("a", 1, "x"), ("b", 2, None), ("c", 3, "xy"), ("d", None, "z")], "_id string, n int, s string"
    ).write.parquet(path("docs"))
    return spark.read.parquet(path("docs"))


def ids(df):
    return [r[0] for r in rows(df.select("_id"))]


def test_field_lookup_reaches_the_scan(docs):
    found = documents.find_by_field(docs, "n", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ids(found) == ["b"] and "EqualTo(n,2)" in plan and "ReadSchema: struct<_id:string,n:int>" in plan
    assert ids(documents.find_by_id(docs, "c")) == ["c"]


@pytest.mark.parametrize(
    "where, want",
    [
        ({"$eq": {"n": 1}}, "a"),
        ({"$ne": {"n": 1}}, "bc"),
        ({"$gt": {"n": 1}, "$lt": {"n": 3}}, "b"),
        ({"$and": [{"$ge": {"n": 1}}, {"$le": {"n": 2}}]}, "ab"),
        ({"$or": [{"$eq": {"n": 1}}, {"$eq": {"s": "z"}}]}, "ad"),
        ({"$not": {"$in": {"n": [1, 2]}}}, "c"),
        ({"$notin": {"n": [1, 2]}}, "c"),
        ({"$like": {"s": "x%"}}, "ac"),
        ({"$matches": {"s": "^x.$"}}, "c"),
        ({"$exists": "s"}, "acd"),
        ({"$notexists": "n"}, "d"),
    ],
)
def test_conditions(docs, where, want):
    assert ids(documents.search(docs, ["_id"], where)) == list(want)


def test_unknown_condition(docs):
    with pytest.raises(ValueError):
        documents.search(docs, ["_id"], {"$near": {"n": 1}})


def test_previews(spark):
    df = spark.range(1000).selectExpr("cast(id as string) _id", "id n")
    assert documents.peek(df, "n").count() == 15
    tail = documents.tail(df, "n")
    assert (tail.count(), tail.agg({"n": "min"}).first()[0]) == (100, 900)
    assert "TakeOrderedAndProject" in tail._jdf.queryExecution().executedPlan().toString()
    assert documents.query(df, "n < 3").count() == 3 and documents.query(df).count() == 1000


def test_progress_and_lag(spark):
    cursors = spark.createDataFrame(
        [("g", 0, 1500, 9, 4), ("h", 0, 0, 9, 10), ("g", 1, 250, -1, 0)],
        "consumergroup string, partitionid bigint, consumerlagmillis bigint, produceroffset bigint, committedoffset bigint",
    )
    assert rows(monitor.topic_progress(cursors)) == [(0, 10, 4), (1, 0, 0)]
    lag = monitor.consumer_lag(cursors)
    assert rows(lag) == [("g", 0, 1.5, 6), ("g", 1, 0.25, 0), ("h", 0, 0.0, 0)]
    assert ("g_0_lag(s)", 1) in rows(monitor.as_series(lag))
    assert ("g_0_offsetBehind", 6) in rows(monitor.as_series(lag))


def test_series_prefix(spark):
    df = spark.sql("select map('a', 1.9D, 'b', 2.0D) as values")
    assert rows(monitor.flatten_series(df, prefix="gold")) == [("gold_a", 1), ("gold_b", 2)]


def test_watched_metrics(spark):
    def message(*records):
        return (json.dumps([{"metric": m, "value": v, "tags": {"clustername": "c"}} for m, v in records]),)

    df = spark.createDataFrame(
        [message(("in", 1.0), ("out", 2.0)), message(("other", 3.0)), message(), ("broken",)], "value string"
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(3661)))
    assert rows(monitor.watched_metrics(df, ["in", "out"])) == [("c", "01:01:01", "in", 1.0)]


def test_watched_metrics_of_a_topic_stream(spark, path):
    record = '[{"metric":"in","value":2.5,"tags":{"clustername":"c"}}]'
    topic = Topic(path("topic"))
    topic.publish(
        spark.range(4).select(
            F.lit(None).alias("key"), F.encode(F.lit(record), "UTF-8").alias("value"),
            F.lit(0).alias("partition"), F.col("id").alias("offset"),
            F.timestamp_seconds("id").alias("timestamp"),
        )
    )
    found = monitor.watched_metrics(topic.read_stream(spark), ["in"])
    query = (
        found.writeStream.format("parquet").option("path", path("out"))
        .option("checkpointLocation", path("cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(path("out")).where("name = 'c' and value = 2.5").count() == 4


def test_metric_row_has_all_columns(spark):
    counters = spark.createDataFrame([("gold_fraud", 4)], "metric string, value bigint")
    row = monitor.metric_row(counters).first().asDict()
    assert len(row) == 10 and row["gold_fraud"] == 4 and row["bronze_customers"] is None


def test_counts_read_no_columns(spark, docs):
    counts = monitor.tier_counts({("bronze", "docs"): docs})
    assert rows(counts) == [("bronze", "docs", 4)]
    stamped = monitor.tier_counts({("bronze", "docs"): docs}, F.current_timestamp())
    assert stamped.columns == ["tier", "series", "value", "ts"]
    assert "ReadSchema: struct<>" in counts._jdf.queryExecution().executedPlan().toString()


def test_lookup_by_id_reaches_the_scan(spark, path):
    spark.range(50).selectExpr("cast(id as string) as _id", "id as n").write.parquet(path("by-id"))
    found = documents.find_by_id(spark.read.parquet(path("by-id")), "42")
    assert rows(found) == [("42", 42)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_id,42)" in plan


def test_tail_with_total(spark):
    df = spark.range(20).withColumnRenamed("id", "n")
    assert rows(documents.tail_with_total(df, "n", 2)) == [(18, 20), (19, 20)]
