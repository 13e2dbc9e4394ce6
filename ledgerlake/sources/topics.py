"""Topics: Kafka, or a directory of records in the shape the Kafka source delivers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import encode_json
from ..functions.scalar import padded
from ..schemas import SEQ_TYPE, TOPIC_RECORD

#: Enough for any partition and any offset; with 13 digits of time they fill a decimal number.
PARTITION_DIGITS, OFFSET_DIGITS = 6, 19

#: Records of a file of a directory at most, so that ``per_trigger`` bounds what a task reads.
RECORDS_PER_FILE = 1 << 18


@dataclass(frozen=True)
class Topic:
    """``location`` is a directory, or the bootstrap servers of a Kafka ``name``.

    ``per_trigger`` bounds a micro-batch: files of a directory, offsets of a Kafka topic.
    Without it a batch takes all there is.
    """

    location: str
    name: str = ""
    kind: str = "files"
    per_trigger: int | None = None
    by_time: bool = False

    def read_stream(self, spark: SparkSession) -> DataFrame:
        """Records from the earliest on; the query's checkpoint keeps the position."""
        if self.kind == "kafka":
            reader = (
                spark.readStream.format("kafka")
                .option("kafka.bootstrap.servers", self.location)
                .option("subscribe", self.name)
                .option("startingOffsets", "earliest")
            )
            if self.per_trigger:
                reader = reader.option("maxOffsetsPerTrigger", self.per_trigger)
            return reader.load().select(*TOPIC_RECORD.names)
        reader = spark.readStream.schema(TOPIC_RECORD)
        if self.per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.per_trigger)
        return reader.parquet(self.location).select(*TOPIC_RECORD.names)

    def order(self) -> Column:
        """A number that orders all records of the topic, without ties.

        Offsets of a Kafka topic only order one partition, so there, and with ``by_time``,
        it is the time at which a record was appended (in milliseconds, as a broker
        keeps it), then the partition, then the offset, as digits of one number.
        """
        if self.kind != "kafka" and not self.by_time:
            return F.col("offset").cast(SEQ_TYPE)
        digits = F.concat(
            F.unix_millis("timestamp").cast("string"),
            padded("partition", PARTITION_DIGITS),
            padded("offset", OFFSET_DIGITS),
        )
        return digits.cast(SEQ_TYPE)

    def read(self, spark: SparkSession) -> DataFrame:
        """All records there are now."""
        if self.kind == "kafka":
            return (
                spark.read.format("kafka")
                .option("kafka.bootstrap.servers", self.location)
                .option("subscribe", self.name)
                .load()
                .select(*TOPIC_RECORD.names)
            )
        return spark.read.schema(TOPIC_RECORD).parquet(self.location).select(*TOPIC_RECORD.names)

    def publish(self, messages: DataFrame, batch_id: int | None = None) -> None:
        """Append messages (see ``as_messages``); with ``batch_id`` a replay replaces itself.

        A Kafka broker has no such replacement: there a replayed batch is sent again, and
        the keyed merge downstream absorbs the repeats.
        """
        if self.kind == "kafka":
            (
                messages.select("key", "value").write.format("kafka")
                .option("kafka.bootstrap.servers", self.location)
                .option("topic", self.name)
                .option("kafka.acks", "all")
                .option("kafka.max.request.size", str(1024 * 1024))
                .save()
            )
            return
        records = messages.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TOPIC_RECORD.fields]
        )
        batch = f"batch-{uuid.uuid4().hex if batch_id is None else batch_id}"
        (
            records.withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", RECORDS_PER_FILE)
            .partitionBy("batch")
            .parquet(self.location)
        )


def as_messages(
    df: DataFrame, offset: Column, key: str = "_id", partitions: int = 1, keep_nulls: bool = True
) -> DataFrame:
    """Rows as keyed JSON messages. A Kafka broker assigns its own partition and offset."""
    key_text = F.col(key).cast("string")
    return df.select(
        F.encode(key_text, "UTF-8").alias("key"),
        F.encode(encode_json(*df.columns, keep_nulls=keep_nulls), "UTF-8").alias("value"),
        F.pmod(F.xxhash64(key_text), F.lit(partitions)).cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )
