"""Transactions from a topic to bronze, and profiles to silver, as one stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decode import decode_json, split_decoded
from ..operators.scoring import Scorer
from ..plans.profiles import PROFILE_SCORER, latest_profiles
from ..sources.tables import RAW, ChangeLog, DeadLetters
from ..sources.topics import Topic
from .progress import observed
from .windows import taken_once


def run(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str,
    every: str | None = None,
) -> StreamingQuery:
    """Process what is there now, batch by batch, then stop; or go on, a batch ``every`` so often.

    The checkpoint is the consumer's position: it moves on only after ``handle`` has
    returned, so a failed batch is handled again. ``handle`` must make a repeated
    batch id harmless.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(**trigger)
        .start()
    )


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a batch while its several writes run, so that it is decoded once."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def ingest_transactions(
    spark: SparkSession,
    topic: Topic,
    bronze: ChangeLog,
    profiles: ChangeLog,
    dead: DeadLetters,
    owners: Callable[[SparkSession], DataFrame],
    checkpoint: str,
    scorer: Scorer = PROFILE_SCORER,
    every: str | None = None,
    once_within: str | None = None,
    name: str = "ingest_transactions",
) -> StreamingQuery:
    """Land transactions and keep each receiver's profile up to date.

    The fields taken from a message are those of the bronze table; a table with
    ``keep_raw`` also stores the whole message.
    ``owners`` reads the account directory (``account_owners``, stored whenever
    customers are loaded). It is called per batch, so that new customers are seen, and
    a batch costs a two-column read of it rather than a deduplication of all customers.
    All three writes replace their own batch; the order of profiles is that of
    the topic, so late batches cannot replace newer profiles.
    With ``once_within`` records sent again within that time are dropped before they are
    written. Each batch's progress tells the last offset taken.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        messages = batch.select("value", topic.order().alias("_seq"))
        with kept(decode_json(messages, bronze.schema)) as decoded:
            if bronze.keep_raw:  # the message is kept once, as it came
                decoded = decoded.withColumn(RAW, F.col("value").cast("string"))
            good, bad = split_decoded(decoded, topic.name or topic.location)
            bronze.write_batch(good, batch_id, seq=F.col("_seq"))
            dead.write(bad, batch_id)
            latest = latest_profiles(good, owners(batch.sparkSession), scorer)
            profiles.write_batch(latest, batch_id, seq=F.col("_seq"))

    records = observed(topic.read_stream(spark))
    if once_within:
        records = taken_once(records, once_within)
    return run(records, handle, checkpoint, name, every)
