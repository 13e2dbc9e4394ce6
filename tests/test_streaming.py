import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake import queries
from ledgerlake.operators.lookup import account_owners
from ledgerlake.plans.gold import possible_fraud
from ledgerlake.plans.profiles import latest_profiles
from ledgerlake.schemas import PROFILES, TRANSACTIONS, table
from ledgerlake.sources import topics
from ledgerlake.sources.tables import ChangeLog, DeadLetters
from ledgerlake.sources.topics import Topic, as_messages
from ledgerlake.streaming import ingest
from ledgerlake.streaming.changes import detect_on_change
from ledgerlake.streaming.flow import FLOW_CATEGORIES, files_to_topic, topic_to_tables
from ledgerlake.streaming.ingest import ingest_transactions

N = 400


@pytest.fixture
def customers(spark):
    return spark.range(40).select(
        F.concat(F.lit("c"), "id").alias("_id"), F.concat(F.lit("ACC"), "id").alias("account_number")
    )


@pytest.fixture
def transactions(spark):
    """A third of all transactions go to one account; some go to unknown ones."""
    receiver = F.when(F.col("id") % 3 == 0, "ACC7").otherwise(
        F.concat(F.lit("ACC"), F.col("id") * 13 % 50)
    )
    return spark.range(N).select(
        F.concat(F.lit("t"), "id").alias("_id"),
        F.lit("S").alias("sender_account"),
        receiver.alias("receiver_account"),
        (F.col("id") * 1.5).alias("amount"),
        (F.col("id") + 0.25).alias("transaction_date"),
        F.col("id").alias("_seq"),
    )


def messages(transactions):
    return as_messages(transactions.drop("_seq"), F.substring("_id", 2, 9).cast("bigint"), partitions=6)


class Run:
    def __init__(self, path, topic, customers):
        self.bronze = ChangeLog(path("bronze"), TRANSACTIONS)
        self.profiles = ChangeLog(path("profiles"), PROFILES)
        self.dead = DeadLetters(path("dead"))
        self.args = (topic, self.bronze, self.profiles, self.dead, lambda s: account_owners(customers))
        self.checkpoint = path("checkpoint")

    def go(self, spark):
        query = ingest_transactions(spark, *self.args, self.checkpoint)
        query.awaitTermination()
        return query


def test_stream_equals_batch_in_any_file_order(spark, path, customers, transactions):
    topic = Topic(path("topic"), per_trigger=1)
    topic.publish(messages(transactions).repartition(6))
    run = Run(path, topic, customers)
    assert len(run.go(spark).recentProgress) >= 5
    assert rows(run.bronze.current(spark)) == rows(transactions.drop("_seq"))
    batch = latest_profiles(transactions, account_owners(customers)).select("_id", "score")
    assert rows(run.profiles.current(spark)) == rows(batch)
    assert run.dead.read(spark).isEmpty()


def test_restart_adds_nothing_and_new_messages_are_picked_up(spark, path, customers, transactions):
    topic = Topic(path("topic"), per_trigger=2)
    first = F.col("_seq") < 300
    topic.publish(messages(transactions.where(first)).repartition(3, "partition"))
    run = Run(path, topic, customers)
    run.go(spark)
    stored = run.bronze.rows(spark).count()
    run.go(spark)
    assert run.bronze.rows(spark).count() == stored == 300
    topic.publish(messages(transactions.where(~first)))
    run.go(spark)
    assert rows(run.bronze.current(spark)) == rows(transactions.drop("_seq"))


def test_lost_checkpoint_means_replay_without_change(spark, path, customers, transactions):
    topic = Topic(path("topic"))
    topic.publish(messages(transactions))
    run = Run(path, topic, customers)
    run.go(spark)
    before = rows(run.bronze.rows(spark).drop("_commit_ts")), rows(run.profiles.current(spark))
    run.checkpoint = path("other-checkpoint")
    run.go(spark)
    assert (rows(run.bronze.rows(spark).drop("_commit_ts")), rows(run.profiles.current(spark))) == before


def test_damaged_messages_are_kept_apart(spark, path, customers, transactions):
    text = F.col("value").cast("string")
    bad = F.col("offset") % 5 == 0
    topic = Topic(path("topic"), per_trigger=2)
    topic.publish(
        messages(transactions)
        .withColumn("value", F.when(bad, F.encode(F.left(text, F.length(text) - 3), "UTF-8")).otherwise(F.col("value")))
        .repartition(6, "partition")
    )
    run = Run(path, topic, customers)
    run.go(spark)
    dead = run.dead.read(spark)
    assert dead.count() == N // 5 and dead.where("reason <> 'damaged' or raw is null").isEmpty()
    assert run.bronze.current(spark).count() + dead.count() == N


def test_failed_batch_is_handled_again(spark, path, customers, transactions):
    topic = Topic(path("topic"))
    topic.publish(messages(transactions))
    run = Run(path, topic, customers)
    working = run.args

    def fail(_):
        raise RuntimeError("lookup is down")

    run.args = (*working[:4], fail)
    with pytest.raises(Exception, match="lookup is down"):
        run.go(spark)
    run.args = working
    run.go(spark)
    assert run.bronze.rows(spark).count() == N
    assert not run.profiles.is_empty(spark)


def test_hops(spark, path, transactions):
    topic = Topic(path("topic"), per_trigger=2)
    topic.publish(messages(transactions).repartition(6, "partition"))
    cells = table(**dict.fromkeys(TRANSACTIONS.names, "string"))
    bronze = ChangeLog(path("bronze"), cells)
    silver = ChangeLog(path("silver"), table(**dict.fromkeys((*TRANSACTIONS.names, "category"), "string")))
    inserted = path("inserted")
    topic_to_tables(
        spark, topic, bronze, silver,
        lambda df, batch: df.write.mode("overwrite").parquet(f"{inserted}/batch={batch}"),
        DeadLetters(path("dead")), path("checkpoint"),
    ).awaitTermination()
    assert bronze.current_patched(spark).count() == N
    assert silver.current_patched(spark).select("category").distinct().count() == FLOW_CATEGORIES
    relational = spark.read.parquet(inserted)
    assert relational.count() == N
    assert relational.where("sender_account <> '' or receiver_account <> ''").isEmpty()


def test_later_message_without_a_field_keeps_the_older_cell(spark, path):
    topic = Topic(path("topic"), per_trigger=1)
    for offset, text in enumerate(['{"_id":"a","amount":5.0,"sender_account":"S"}', '{"_id":"a","amount":6.0}']):
        record = spark.createDataFrame([(b"a", text.encode(), 0, offset, None)],
                                       "key binary, value binary, partition int, offset bigint, timestamp timestamp")
        topic.publish(record.coalesce(1))
    cells = table(**dict.fromkeys(TRANSACTIONS.names, "string"))
    bronze = ChangeLog(path("bronze"), cells)
    silver = ChangeLog(path("silver"), table(**dict.fromkeys((*TRANSACTIONS.names, "category"), "string")))
    topic_to_tables(
        spark, topic, bronze, silver, lambda df, batch: None, DeadLetters(path("dead")), path("checkpoint")
    ).awaitTermination()
    assert rows(bronze.current_patched(spark).select("_id", "amount", "sender_account")) == [("a", "6.0", "S")]


def test_dropped_files_are_published_and_logged(spark, path):
    os.mkdir(path("in"))
    header = ",".join(TRANSACTIONS.names)
    for i in range(3):
        with open(f"{path('in')}/bulk-{i}.csv", "w") as f:
            f.write(f"{header}\n t{i} ,S,R,{i}.5,1.0\n,S,R,1,1\nx{i},S,R,1.0,1.0,extra\n")
    with open(f"{path('in')}/other.csv", "w") as f:
        f.write(f"{header}\nzz,S,R,1,1\n")
    topic, dead = Topic(path("topic")), DeadLetters(path("dead"))
    files_to_topic(
        spark, path("in"), topic, F.substring("_id", 2, 9).cast("bigint"), dead, path("checkpoint"),
        file_pattern="bulk-*", audit_path=path("audit"), files_per_poll=1,
    ).awaitTermination()
    sent = topic.read(spark).select(F.col("key").cast("string"), F.col("value").cast("string"))
    assert [r.key for r in sent.orderBy("key").collect()] == ["t0", "t1", "t2"]
    assert '"amount":2.5' in sent.where("key = 't2'").first()[1]
    assert spark.read.json(path("audit")).count() == 3
    assert sorted(r.reason for r in dead.read(spark).collect()) == ["damaged"] * 3 + ["missing key"] * 3


def test_changes_drive_detection(spark, path, transactions):
    bronze = ChangeLog(path("bronze"), TRANSACTIONS)
    fraud = ChangeLog(
        path("fraud"), table(_id="string", amount="double", transaction_date="double", fraud="boolean")
    )
    parts = [F.col("_seq") < 150, F.col("_seq") >= 150]
    for batch, part in enumerate(parts):
        bronze.write_batch(transactions.where(part), batch, seq=F.col("_seq"))
        detect_on_change(spark, bronze, fraud, path("checkpoint")).awaitTermination()
    assert rows(fraud.current(spark)) == rows(possible_fraud(transactions.drop("_seq")))
    stored = fraud.rows(spark).count()
    bronze.write_batch(transactions.where(parts[1]), 1, seq=F.col("_seq"))
    detect_on_change(spark, bronze, fraud, path("checkpoint")).awaitTermination()
    assert rows(fraud.current(spark)) == rows(possible_fraud(transactions.drop("_seq")))
    assert fraud.rows(spark).count() >= stored


def test_continuous_trigger_picks_up_later_messages(spark, path, transactions):
    topic = Topic(path("topic"))
    first = F.col("_seq") < 100
    topic.publish(messages(transactions.where(first)))
    bronze = ChangeLog(path("bronze"), table(**dict.fromkeys(TRANSACTIONS.names, "string")))
    silver = ChangeLog(path("silver"), table(**dict.fromkeys((*TRANSACTIONS.names, "category"), "string")))
    query = topic_to_tables(
        spark, topic, bronze, silver, lambda df, batch: None, DeadLetters(path("dead")),
        path("checkpoint"), every="200 milliseconds",
    )
    try:
        query.processAllAvailable()
        topic.publish(messages(transactions.where(~first)))
        query.processAllAvailable()
    finally:
        query.stop()
    assert bronze.current_patched(spark).count() == N
    assert bronze.rows(spark).select("batch_id").distinct().count() == 2


def test_republished_batch_replaces_itself(spark, path, transactions):
    topic = Topic(path("topic"))
    for _ in range(2):
        topic.publish(messages(transactions), batch_id=3)
    topic.publish(messages(transactions.limit(5)))
    assert topic.read(spark).count() == N + 5
    assert topic.read(spark).columns == ["key", "value", "partition", "offset", "timestamp"]


def file_sizes(topic, spark):
    files = topic.read(spark).groupBy(F.input_file_name()).agg(F.count("*").alias("n"))
    return sorted(r.n for r in files.collect())


def test_files_of_a_topic_are_bounded_and_so_are_batches(spark, path, customers, transactions, monkeypatch):
    monkeypatch.setattr(topics, "RECORDS_PER_FILE", 90)
    topic = Topic(path("topic"), per_trigger=1)
    topic.publish(messages(transactions).coalesce(1))
    assert file_sizes(topic, spark) == [40, 90, 90, 90, 90]
    run = Run(path, topic, customers)
    run.go(spark)
    batches = run.bronze.rows(spark).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in batches) == [40, 90, 90, 90, 90]
    assert rows(run.bronze.current(spark)) == rows(transactions.drop("_seq"))


def test_transactions_are_dealt_evenly(spark, path):
    n, key = 6000, F.col("id")
    spark.range(n).select(
        key.alias("o_orderkey"), (key % 50).alias("o_custkey"), (key * 1.5).alias("o_totalprice"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("o_orderdate"),
    ).write.parquet(f"{path('sf')}/orders.parquet")
    topic = queries._topic(spark, path("sf"))
    sizes = file_sizes(topic, spark)
    assert sum(sizes) == n and len(sizes) >= 3 * topic.per_trigger
    assert sizes[-1] < 1.5 * n / len(sizes)


def test_a_kept_batch_holds_its_messages_once(spark, path, customers, transactions, monkeypatch):
    held = []

    def kept(df):
        held.append(df.columns)
        return ingest_kept(df)

    ingest_kept = ingest.kept
    monkeypatch.setattr(ingest, "kept", kept)
    topic = Topic(path("topic"))
    topic.publish(messages(transactions))
    run = Run(path, topic, customers)
    run.bronze = ChangeLog(path("whole"), TRANSACTIONS, keep_raw=True)
    run.args = (topic, run.bronze, *run.args[2:])
    run.go(spark)
    assert held == [["value", "_seq", "record", "_damaged"]]
    stored = run.bronze.rows(spark)
    sent = topic.read(spark).select(F.col("value").cast("string"))
    assert rows(stored.select("_raw")) == rows(sent)


@pytest.mark.parametrize("name", ["profiles_tied_times", "stream_bronze_extra_fields"])
def test_topics_that_are_not_dealt_come_in_bounded_batches(spark, path, monkeypatch, name):
    class Seen(Exception):
        pass

    def ingested(spark, sf, topic):
        raise Seen(topic)

    spark.sql("select 7L as o_orderkey, 1L as o_custkey, 2.5D as o_totalprice, timestamp_ntz'2020-01-01 00:00:00' as o_orderdate") \
        .write.parquet(f"{path('sf')}/orders.parquet")
    monkeypatch.setattr(queries, "_Ingested", ingested)
    with pytest.raises(Seen) as seen:
        getattr(queries, name)(spark, path("sf"))
    assert seen.value.args[0].per_trigger == spark.sparkContext.defaultParallelism
