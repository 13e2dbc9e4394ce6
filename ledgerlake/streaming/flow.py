"""The multi-hop flows: topic to bronze, silver and a relational table; files to topic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.scalar import pick_category
from ..operators.decode import decode_json, split_decoded
from ..plans.silver import blank_accounts
from ..schemas import TRANSACTIONS
from ..sources.files import CSV_DIALECT, as_text, in_header_order
from ..sources.tables import ChangeLog, DeadLetters
from ..sources.topics import Topic, as_messages
from .ingest import kept, run

# The flow draws from the first ten categories, and takes this many
# files per poll.
FLOW_CATEGORIES = 10
FILES_PER_POLL = 100


def as_cells(df: DataFrame) -> DataFrame:
    """Every column as text, the way a wide-column table stores its cells."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def topic_to_tables(
    spark: SparkSession,
    topic: Topic,
    bronze: ChangeLog,
    silver: ChangeLog,
    relational: Callable[[DataFrame, int], None],
    dead: DeadLetters,
    checkpoint: str,
    schema: StructType = TRANSACTIONS,
    every: str | None = None,
) -> StreamingQuery:
    """Each batch goes to bronze, gets a category, goes to silver, loses its accounts and
    is inserted into a relational table. A hop runs only after the one before it has
    written. ``relational`` gets the batch id so that it can make replays harmless.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        messages = batch.select("value", topic.order().alias("_seq"))
        with kept(decode_json(messages, schema)) as decoded:
            good, bad = split_decoded(decoded, topic.name or topic.location)
            dead.write(bad, batch_id)
            cells = as_cells(good)
            bronze.write_batch(cells, batch_id, seq=F.col("_seq"))
            categorised = cells.withColumn("category", pick_category("_id", FLOW_CATEGORIES))
            silver.write_batch(categorised, batch_id, seq=F.col("_seq"))
            relational(blank_accounts(categorised.drop("_seq")), batch_id)

    return run(topic.read_stream(spark), handle, checkpoint, "topic_to_tables", every)


def files_to_topic(
    spark: SparkSession,
    directory: str,
    topic: Topic,
    offset: Column,
    dead: DeadLetters,
    checkpoint: str,
    file_pattern: str = "*",
    audit_path: str | None = None,
    schema: StructType = TRANSACTIONS,
    delete_read_files: bool = True,
    files_per_poll: int = FILES_PER_POLL,
    every: str | None = None,
) -> StreamingQuery:
    """Pick up dropped CSV files, publish their rows keyed by ``_id``, log what was sent.

    ``offset`` orders the records of a file-backed topic. Rows that are malformed, have
    no key or a value of the wrong type become dead letters. Columns are found by the
    header of the files that are there at the start (without any, the schema's order is
    assumed); a file with another header stops the stream. Read files are deleted by
    Spark after their batch is complete.
    """
    present = (
        spark.read.options(**CSV_DIALECT)
        .option("pathGlobFilter", file_pattern)
        .csv(directory)
        .columns
    )
    stored = in_header_order(present or schema.names, as_text(schema))
    files = (
        spark.readStream.schema(stored)
        .options(**CSV_DIALECT)
        .option("enforceSchema", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_damaged")
        .option("pathGlobFilter", file_pattern)
        .option("maxFilesPerTrigger", files_per_poll)
        .option("cleanSource", "delete" if delete_read_files else "off")
        .csv(directory)
    )
    names = schema.names

    def handle(batch: DataFrame, batch_id: int) -> None:
        raw = F.coalesce(F.col("_damaged"), F.to_csv(F.struct(*names)))
        rows = batch.select(F.struct(*names).alias("record"), raw.alias("value"), "_damaged")
        with kept(rows):
            good, bad = split_decoded(rows, directory)
            casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
            broken = reduce(Column.__or__, [F.col(n).isNotNull() & c.isNull() for n, c in casts.items()])
            typed = good.where(~broken).select([c.alias(n) for n, c in casts.items()])
            topic.publish(as_messages(typed, offset), batch_id)
            wrong = good.where(broken).select(
                F.lit("bad value").alias("reason"),
                F.to_csv(F.struct(*names)).alias("raw"),
                F.lit(directory).alias("source"),
            )
            dead.write(bad.unionByName(wrong), batch_id)
            if audit_path:
                (
                    typed.withColumn("batch_id", F.lit(batch_id))
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("batch_id")
                    .json(audit_path)
                )

    return run(files, handle, checkpoint, "files_to_topic", every)
