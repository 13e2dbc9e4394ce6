"""Registered queries of event-time streams, running queries and change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.scalar import pick_category
from .operators.lookup import account_owners
from .oracle import _CATEGORIES, _TRANSACTIONS, _hash
from .plans import adapters
from .plans.adapters import load
from .registry import SQL, query
from .session import scratch_path
from .sources.files import read_parquet_or_empty, write_parquet
from .sources.tables import ChangeLog, DeadLetters
from .sources.topics import Topic, as_messages
from .streaming import progress, windows
from .streaming.ingest import ingest_transactions

#: Rows come in this many parts, in order of time, each a run of the stream to its end.
PARTS = 4


class InTime:
    """Rows that reach a stream in parts, in order of their column ``time``, and then some too late."""

    def __init__(self, spark: SparkSession, rows: DataFrame, late: Column | None = None):
        micros = F.unix_micros("time")
        first, last = rows.agg(F.min(micros), F.max(micros)).first()
        place = (micros - F.lit(first)).cast("double") / F.lit(float(last - first)) * PARTS
        part = F.least(F.floor(place), F.lit(PARTS - 1))
        late = F.lit(False) if late is None else late & (part < PARTS // 2)
        self.rows = rows.withColumn("_part", F.when(late, PARTS).otherwise(part))
        self.spark, self.schema = spark, rows.schema
        self.source = scratch_path(spark, "rows-in-time")
        self.target = scratch_path(spark, "closed-windows")
        self.checkpoint = scratch_path(spark, "checkpoint")

    def closed(self, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run the stream to its end after each part; the windows that it closed."""
        self.reports = []
        for part in range(PARTS + 1):
            rows = self.rows.where(F.col("_part") == part).drop("_part")
            write_parquet(rows, f"{self.source}/{part}")
            made = transform(windows.stream_files(self.spark, self.source, self.schema))
            run = windows.closed_windows(made, self.target, self.checkpoint, "closed_windows")
            run.awaitTermination()
            self.reports += run.recentProgress
        return read_parquet_or_empty(self.spark, self.target, made.schema)


def category_hours(rows: DataFrame) -> DataFrame:
    """Transactions and their sum in cents per category and hour."""
    cents = F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents")
    return windows.windowed(rows, "time", ["category"], [F.count("*").alias("transactions"), cents])


@query
def stream_category_hours(spark, sf):
    """Hours closed by a stream; every twentieth transaction of the first half comes too late."""
    rows = adapters.transactions(spark, sf).select(
        "_id", pick_category("_id").alias("category"), "amount",
        F.timestamp_seconds("transaction_date").alias("time"),
    )
    made = InTime(spark, rows, F.col("_id").cast("bigint") % 20 == 0).closed(category_hours)
    return made.select(F.unix_seconds("window_start").alias("hour"), "category", "transactions", "cents")


SQL["stream_category_hours"] = f"""
WITH {_TRANSACTIONS}, timed AS (
    SELECT *, {_CATEGORIES}[1 + {_hash('_id', 11)}] AS category, min(transaction_date) OVER () AS lo, max(transaction_date) OVER () AS hi
    FROM v_transactions
), in_time AS (
    SELECT *, CAST(floor(transaction_date / 3600) * 3600 AS BIGINT) AS hour FROM timed
    WHERE NOT (seq % 20 = 0 AND (transaction_date - lo) / (hi - lo) * 4 < 2)
)
SELECT hour, category, count(*) AS transactions, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents
FROM in_time WHERE hour + 3600 <= hi - 86400 GROUP BY hour, category"""


def _timed_events(spark, sf) -> DataFrame:
    # the table's times carry no zone: they are taken as UTC
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", F.timestamp_micros(micros).alias("time"))


@query
def stream_event_windows(spark, sf):
    """Sliding windows of two hours, one each hour, of events by type."""
    made = InTime(spark, _timed_events(spark, sf)).closed(
        lambda rows: windows.windowed(
            rows, "time", ["event_type"], [F.count("*").alias("events")], "2 hours", "6 hours", slide="1 hour"
        )
    )
    return made.select(F.unix_seconds("window_start").alias("start"), "event_type", "events")


SQL["stream_event_windows"] = """
WITH e AS (
    SELECT event_type, epoch_us(ts) AS us, max(epoch_us(ts)) OVER () AS hi FROM events
), w AS (
    SELECT event_type, hi, (us // 3600000000) * 3600 - 3600 * k AS start FROM e, (SELECT unnest([0, 1]) AS k)
)
SELECT CAST(start AS BIGINT) AS start, event_type, count(*) AS events FROM w
WHERE (start + 7200) * 1000000 <= hi - 21600000000 GROUP BY ALL"""


@query
def stream_user_sessions(spark, sf):
    """Sessions of each user, closed by six hours without an event."""
    measures = [F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")]
    made = InTime(spark, _timed_events(spark, sf)).closed(
        lambda rows: windows.sessions(rows, "time", ["user_id"], measures, "6 hours", "12 hours")
    )
    return made.select(
        "user_id", F.unix_micros("window_start").alias("first_us"), F.unix_micros("window_end").alias("end_us"),
        "events", "purchases",
    )


SQL["stream_user_sessions"] = """
WITH e AS (
    SELECT user_id, event_type, epoch_us(ts) AS us, max(epoch_us(ts)) OVER () AS hi FROM events
), marked AS (
    SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000, true) AS opens FROM e
), numbered AS (
    SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS session FROM marked
)
SELECT user_id, min(us) AS first_us, max(us) + 21600000000 AS end_us, count(*) AS events,
    count(*) FILTER (event_type = 'purchase') AS purchases
FROM numbered GROUP BY user_id, session, hi HAVING max(us) + 21600000000 <= hi - 43200000000"""


class Ingest:
    """The streaming ingest over a topic that messages are added to, run whenever asked."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark = spark
        self.topic = Topic(scratch_path(spark, "topic"), name="transactions")
        self.bronze = ChangeLog(scratch_path(spark, "bronze"), schemas.TRANSACTIONS)
        self.profiles = ChangeLog(scratch_path(spark, "profiles"), schemas.PROFILES)
        self.dead = DeadLetters(scratch_path(spark, "dead"))
        self.checkpoint = scratch_path(spark, "checkpoint")
        owners = scratch_path(spark, "account-owners")
        write_parquet(account_owners(adapters.customers(spark, sf)), owners)
        self.owners = lambda session: session.read.parquet(owners)

    def start(self, **options):
        return ingest_transactions(
            self.spark, self.topic, self.bronze, self.profiles, self.dead, self.owners, self.checkpoint, **options
        )

    def drain(self, **options) -> None:
        self.start(**options).awaitTermination()


@query
def stream_dedup_window(spark, sf):
    """Every third message is sent again, some at once and some later: each is stored once."""
    run = Ingest(spark, sf)
    rows = adapters.transactions(spark, sf, with_seq=True)
    messages = as_messages(rows, F.col("_seq"))
    again = messages.where(F.col("offset") % 3 == 0).withColumn("offset", F.col("offset") + 10_000_000_000)
    run.topic.publish(messages.unionByName(again.where(F.col("offset") % 2 == 0)))
    run.drain(once_within="1 hour")
    run.topic.publish(again)
    run.drain(once_within="1 hour")
    return run.bronze.rows(spark).select(*schemas.TRANSACTIONS.names)


SQL["stream_dedup_window"] = f"WITH {_TRANSACTIONS} SELECT * EXCLUDE (seq) FROM v_transactions"


@query
def stream_progress(spark, sf):
    """Two consumers of a topic, one of which misses the later messages: what their reports tell."""
    first, second = Ingest(spark, sf), Ingest(spark, sf)
    second.topic = first.topic
    rows = adapters.transactions(spark, sf, with_seq=True)
    early = F.col("_seq") % 10 != 0
    reports = scratch_path(spark, "reports")
    with progress.recorded(spark, reports):
        first.topic.publish(as_messages(rows.where(early), F.col("_seq")))
        first.drain(name="consumer_a")
        second.drain(name="consumer_b")
        first.topic.publish(as_messages(rows.where(~early), F.col("_seq") + F.lit(1_000_000_000)))
        first.drain(name="consumer_a")
    batches = progress.progress(spark, reports)
    state = progress.topic_state(first.topic.read(spark), batches)
    return progress.consumers(batches).drop("busy_ms").crossJoin(F.broadcast(state))


SQL["stream_progress"] = """
WITH early AS (SELECT count(*) AS n, max(o_orderkey) + 1 AS next FROM orders WHERE o_orderkey % 10 <> 0),
whole AS (SELECT count(*) AS n, max(o_orderkey) + 1000000001 AS next FROM orders WHERE o_orderkey % 10 = 0)
SELECT 'consumer_a' AS query, 2 AS batches, CAST(early.n + whole.n AS BIGINT) AS rows_taken, whole.next AS next_offset,
    whole.next AS published, early.next AS processed FROM early, whole
UNION ALL SELECT 'consumer_b', 1, early.n, early.next, whole.next, early.next FROM early, whole"""


@query
def stream_quiet_stop(spark, sf):
    """A continuous ingest stops once no message has come for a second, and goes on from there."""
    run = Ingest(spark, sf)
    rows = adapters.transactions(spark, sf, with_seq=True)
    early = F.col("_seq") % 4 != 0
    for part in (early, ~early):
        run.topic.publish(as_messages(rows.where(part), F.col("_seq")))
        progress.stop_when_quiet(run.start(every="200 milliseconds"), 1.0)
    return run.bronze.rows(spark).select(*schemas.TRANSACTIONS.names)


SQL["stream_quiet_stop"] = SQL["stream_dedup_window"]
