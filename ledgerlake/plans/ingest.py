"""Landing of raw data in bronze."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import file_order, keep_latest
from ..sources.files import DAMAGED, read_csv_text, read_csv_typed
from ..sources.tables import ChangeLog, DeadLetters


def ingest_customers(
    spark: SparkSession,
    csv_path: str,
    bronze: ChangeLog,
    batch_id: int,
    dead: DeadLetters,
    multi_line: bool = False,
) -> None:
    """Customer CSV to bronze: all text, last row per id, then one log batch.

    Malformed rows and rows without an id go to ``dead``. Files whose values hold line
    breaks need ``multi_line``.
    """
    _land(read_csv_text(spark, csv_path, bronze.schema, multi_line), csv_path, bronze, batch_id, dead)


def ingest_customers_typed(
    spark: SparkSession,
    csv_path: str,
    bronze: ChangeLog,
    batch_id: int,
    dead: DeadLetters,
    multi_line: bool = False,
) -> None:
    """The body of a scheduled job: the same, with types read off the file."""
    scanned = read_csv_typed(spark, csv_path, multi_line=multi_line, damaged=True)
    _land(scanned, csv_path, bronze, batch_id, dead)


def _land(scanned: DataFrame, source: str, bronze: ChangeLog, batch_id: int, dead: DeadLetters) -> None:
    """Every row goes to one of the two: the latest usable rows to bronze, the others to ``dead``."""
    reason = rejected(bronze.key)
    rows = file_order(scanned).where(reason.isNull()).drop(DAMAGED)
    bronze.write_batch(keep_latest(rows, bronze.key, "_file_order"), batch_id)
    values = [c for c in scanned.columns if c != DAMAGED]
    bad = scanned.select(
        reason.alias("reason"),
        F.coalesce(F.col(DAMAGED), F.to_csv(F.struct(*values))).alias("raw"),
        F.lit(source).alias("source"),
    )
    dead.write(bad.where(F.col("reason").isNotNull()), batch_id)


def rejected(key: str) -> Column:
    return F.when(F.col(DAMAGED).isNotNull(), "damaged").when(F.col(key).isNull(), "missing key")
