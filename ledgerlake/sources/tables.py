"""Tier tables as plain Parquet: a change log of batches, and merged versions.

A change log takes one cheap append per batch and is read as its latest rows. A
versioned table holds merged state: each merge writes a new directory, and readers
move to it only after the write is complete. One writer per table.

Where a catalog offers a table format with row-level changes, use
``operators.merge.merge_into_catalog`` instead of either.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.changes import change_feed
from ..operators.dedup import keep_latest
from ..operators.merge import merge, one_per_key, split_missing_keys
from ..schemas import DEAD_LETTERS, SEQ_TYPE
from ..schemas import table as columns
from ..session import materialize
from .files import ddl, read_parquet_or_empty

RAW = "_raw"
#: The order of a log's rows under a key.
ORDER = ("_seq", "batch_id")
_RAW_COLUMN = columns(_raw="string")
_LOG_COLUMNS = columns(_seq=SEQ_TYPE, _commit_ts="timestamp", batch_id="long")
_COMMIT_COLUMNS = columns(version="long", directory="string", committed_at="timestamp")


@dataclass(frozen=True)
class ChangeLog:
    """Rows as they came, partitioned by ``batch_id``.

    ``_seq`` is the source's own order (an offset, an event id). Batches can arrive
    out of order, so ``batch_id`` only breaks ties of ``_seq``; a source without an
    order of its own passes its batch id as ``_seq``.

    ``keep_raw`` stores the text ``_raw`` of the message beside the columns read from it,
    so that fields the schema lacks are not lost; ``rows`` returns it.
    """

    path: str
    schema: StructType
    key: str = "_id"
    keep_raw: bool = False

    @property
    def stored_schema(self) -> StructType:
        raw = _RAW_COLUMN.fields if self.keep_raw else []
        return StructType(self.schema.fields + raw + _LOG_COLUMNS.fields)

    def _with_log_columns(
        self, df: DataFrame, seq: Column, batch_id: Column, commit_ts: Column
    ) -> DataFrame:
        rows = df.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields],
            *([F.col(RAW)] if self.keep_raw else []),
            seq.cast(SEQ_TYPE).alias("_seq"),
            commit_ts.cast("timestamp").alias("_commit_ts"),
            batch_id.cast("bigint").alias("batch_id"),
        )
        return rows.where(F.col(self.key).isNotNull())

    def write_batch(
        self, df: DataFrame, batch_id: int, seq: Column | None = None, commit_ts: Column | None = None
    ) -> None:
        """Write one batch. Writing the same batch again replaces it and nothing else."""
        rows = self._with_log_columns(
            df,
            F.lit(batch_id) if seq is None else seq,
            F.lit(batch_id),
            F.current_timestamp() if commit_ts is None else commit_ts,
        )
        # One directory, overwritten as it is: a replay without rows leaves none of the old ones.
        rows.drop("batch_id").write.mode("overwrite").parquet(f"{self.path}/batch_id={int(batch_id)}")

    def write_batches(
        self, df: DataFrame, batch_id: Column, seq: Column, commit_ts: Column
    ) -> None:
        """Write many batches at once, as a backfill does; ``batch_id`` is per row."""
        rows = self._with_log_columns(df, seq, batch_id, commit_ts)
        # Rows of one batch go together, and a batch too large for a task is split.
        self._overwrite_batches(rows.hint("rebalance", "batch_id"))

    def _overwrite_batches(self, rows: DataFrame) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(self.path)
        )

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of all batches; empty if nothing was written yet."""
        return read_parquet_or_empty(spark, self.path, self.stored_schema)

    def is_empty(self, spark: SparkSession) -> bool:
        """Looks at the stored rows, so no deduplication runs."""
        return self.rows(spark).isEmpty()

    def current(self, spark: SparkSession, with_seq: bool = False) -> DataFrame:
        """The latest whole row per key."""
        latest = keep_latest(self.rows(spark), self.key, ["_seq", "batch_id"])
        return latest.select(*self.schema.names, *(["_seq"] if with_seq else []))

    def view(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The latest whole row per key with its ``_seq`` and ``batch_id``; of the batches up to ``upto``.

        Batches are partitions, so later ones are not read.
        """
        rows = self.rows(spark)
        rows = rows if upto is None else rows.where(F.col("batch_id") <= upto)
        return keep_latest(rows, self.key, ORDER).select(*self.schema.names, *ORDER)

    def refreshed(self, spark: SparkSession, stored: DataFrame, since: int) -> DataFrame:
        """``view`` again, from a stored one of the batches up to ``since`` and the later batches alone.

        Only the keys that the new batches touch are deduplicated; the others stay where they
        are, and while the touched keys are few the stored rows are not shuffled.
        """
        new = self.rows(spark).where(F.col("batch_id") > since).select(*self.schema.names, *ORDER)
        touched = materialize(new.select(self.key).distinct(), "touched-keys")
        again = stored.join(touched, self.key, "left_semi").unionByName(new)
        return stored.join(touched, self.key, "left_anti").unionByName(keep_latest(again, self.key, ORDER))

    def changes(self, spark: SparkSession, since: int | None = None) -> DataFrame:
        """The changes (``change_feed``) that the log holds; those of the batches after ``since``.

        Of a later batch rows that are older than what was there change nothing and are left out.
        """
        rows = self.rows(spark)
        if since is None:
            return change_feed(rows, self.key, ORDER, self.schema.names)
        new = rows.where(F.col("batch_id") > since)
        touched = materialize(new.select(self.key).distinct(), "touched-keys")
        earlier = rows.where(F.col("batch_id") <= since).join(touched, self.key, "left_semi")
        known = materialize(keep_latest(earlier, self.key, ORDER), "known-rows")
        at = known.select(F.col(self.key).alias("_known"), F.struct(*ORDER).alias("_at"))
        newer = new.join(at, F.col(self.key) == F.col("_known"), "left").where(
            F.col("_at").isNull() | (F.struct(*ORDER) > F.col("_at"))
        )
        both = known.unionByName(newer.select(*known.columns))
        return change_feed(both, self.key, ORDER, self.schema.names).where(F.col("batch_id") > since)

    def current_patched(self, spark: SparkSession) -> DataFrame:
        """Per key the latest non-null value of every column.

        This is a wide-column put that skips nulls: cells a later row does not carry
        keep their older value. Aggregated on the map side first.
        """
        order = F.struct("_seq", "batch_id")
        others = [c for c in self.schema.names if c != self.key]
        return (
            self.rows(spark)
            .groupBy(self.key)
            .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in others])
            .select(*self.schema.names)
        )

    def history(self, spark: SparkSession) -> DataFrame:
        """Batches with their commit time and size."""
        return (
            self.rows(spark)
            .groupBy(F.col("batch_id").alias("id"))
            .agg(
                F.date_format(F.min("_commit_ts"), "yyyy-MM-dd HH:mm:ss").alias("date"),
                F.count("*").alias("rows"),
            )
            .select("date", "id", "rows")
        )


@dataclass(frozen=True)
class VersionedTable:
    """Merged state, a directory per version; ``commits`` says which are complete.

    With ``buckets`` the files are bucketed and sorted by the key. A merge then reads
    the stored side in place and shuffles only the source, and two tables with equal
    buckets are joined on the key without any shuffle. Choose the number so that a
    bucket fits a task (some hundred megabytes); it must stay as it is.
    """

    path: str
    schema: StructType | None = None
    buckets: int = 0
    key: str = "_id"

    def commits(self, spark: SparkSession) -> DataFrame:
        return read_parquet_or_empty(spark, f"{self.path}/commits", _COMMIT_COLUMNS)

    def _last_commit(self, spark: SparkSession) -> tuple[int, str | None]:
        last = self.commits(spark).agg(F.max(F.struct("version", "directory"))).first()[0]
        return (last.version, last.directory) if last else (0, None)

    def location(self, spark: SparkSession) -> str | None:
        """The directory of the last complete version: what other engines should read."""
        _, directory = self._last_commit(spark)
        return f"{self.path}/{directory}" if directory else None

    def exists(self, spark: SparkSession) -> bool:
        return self.location(spark) is not None

    def is_empty(self, spark: SparkSession) -> bool:
        location = self.location(spark)
        return location is None or spark.read.parquet(location).isEmpty()

    def read(self, spark: SparkSession) -> DataFrame:
        """The last complete version, or an empty typed frame before the first."""
        version, directory = self._last_commit(spark)
        if version:
            return self._open(spark, directory)
        if self.schema is None:
            raise ValueError(f"{self.path} was never written and has no schema")
        return spark.createDataFrame([], self.schema)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.read(spark)

    def _open(self, spark: SparkSession, directory: str) -> DataFrame:
        location = f"{self.path}/{directory}"
        stored = spark.read.parquet(location)
        if not self.buckets:
            return stored
        # The session's catalog has to know the buckets for the planner to use them.
        name = directory.replace("-", "_")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({ddl(stored.schema)}) USING parquet "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS "
            f"LOCATION '{location}'"
        )
        return spark.table(name)

    def publish(self, df: DataFrame, clustered: bool = False) -> int:
        """Write ``df`` as the next version, then record it.

        ``clustered`` rows already lie together by the table's buckets; others are
        shuffled first, so that a bucket becomes one file.
        """
        return self._write_version(df, self._last_commit(df.sparkSession)[0] + 1, clustered)

    def _write_version(self, df: DataFrame, version: int, clustered: bool) -> int:
        spark = df.sparkSession
        # Every attempt has a directory of its own: one that failed is never read.
        directory = f"v{version}-{uuid.uuid4().hex}"
        location = f"{self.path}/{directory}"
        if self.buckets:
            rows = df if clustered else df.repartition(self.buckets, self.key)
            (
                rows.write.format("parquet")
                .bucketBy(self.buckets, self.key)
                .sortBy(self.key)
                .option("path", location)
                .saveAsTable(directory.replace("-", "_"))
            )
        else:
            df.write.parquet(location)
        record = spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"),
            F.lit(directory).alias("directory"),
            F.current_timestamp().alias("committed_at"),
        )
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def upsert(
        self,
        source: DataFrame,
        mode: str = "update",
        clustered: bool = False,
        order: str | list[str] | None = None,
        dead: DeadLetters | None = None,
        batch_id: int = 0,
        **options,
    ) -> int:
        """Merge ``source`` into the last version, or create the first.

        Of rows that repeat a key the latest by ``order`` counts; without an order a
        repeated key fails the job. Rows without a key go to ``dead``, or fail the job
        if there is none. Say ``clustered`` if the source comes, without a shuffle in
        between, from a table with the same buckets.
        """
        spark = source.sparkSession
        version, directory = self._last_commit(spark)
        if dead:
            source, bad = split_missing_keys(source, self.key)
            raw = F.to_json(F.struct(*bad.columns))
            dead.write(
                bad.select(F.lit("missing key").alias("reason"), raw.alias("raw"), F.lit(self.path).alias("source")),
                batch_id,
            )
        elif not source.where(F.col(self.key).isNull()).isEmpty():
            # the filter reaches the scan, which then reads the key only
            raise ValueError(f"no {self.key} in a row for {self.path}")
        source = one_per_key(source, self.key, order, f"a source for {self.path}")
        if directory is None:
            return self._write_version(self._as_declared(source), 1, clustered)
        if self.buckets and not clustered:
            # To the target's partitioning, or the planner might shuffle the target instead.
            source = source.repartition(self.buckets, self.key)
        merged = merge(
            self._open(spark, directory), source, self.key, mode, unique=("target", "source"), **options
        )
        return self._write_version(merged, version + 1, clustered=True)

    def _as_declared(self, source: DataFrame) -> DataFrame:
        """The declared columns first, null where the source lacks one, then what else it has."""
        if self.schema is None:
            return source
        declared = [
            (F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema.fields
        ]
        return source.select(*declared, *[c for c in source.columns if c not in self.schema.names])

    def same_buckets(self, other: object) -> bool:
        return bool(self.buckets) and isinstance(other, VersionedTable) and (
            (self.buckets, self.key) == (other.buckets, other.key)
        )

    def history(self, spark: SparkSession) -> DataFrame:
        """Versions with their commit time."""
        return self.commits(spark).select(
            F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("date"),
            F.col("version").alias("id"),
        )


@dataclass(frozen=True)
class DeadLetters:
    """Rejected rows with ``reason, raw, source``, one directory per batch."""

    path: str

    def write(self, bad: DataFrame, batch_id: int) -> None:
        """Replaces what the batch wrote before, also by nothing."""
        bad.write.mode("overwrite").parquet(f"{self.path}/batch_id={int(batch_id)}")

    def read(self, spark: SparkSession) -> DataFrame:
        return read_parquet_or_empty(spark, self.path, DEAD_LETTERS)


Table = ChangeLog | VersionedTable


def require_rows(spark: SparkSession, *tables: Table) -> None:
    """Stop a job before it starts if one of its inputs is missing or empty."""
    for table in tables:
        if table.is_empty(spark):
            raise ValueError(f"no rows in {table.path}")
