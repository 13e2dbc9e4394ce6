"""Fraud detection driven by the changes that arrive in bronze."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import FRAUD_THRESHOLD, Scorer
from ..plans.gold import FRAUD_SCORER, possible_fraud
from ..sources.tables import ChangeLog
from .ingest import run


def detect_on_change(
    spark: SparkSession,
    bronze: ChangeLog,
    fraud: ChangeLog,
    checkpoint: str,
    scorer: Scorer = FRAUD_SCORER,
    threshold: int = FRAUD_THRESHOLD,
    files_per_batch: int = 1000,
    every: str | None = None,
) -> StreamingQuery:
    """Follow the bronze change log and log the flagged transactions.

    Only new batches are read. Flagged rows are appended to a log of their own, so the
    cost is that of the change; ``VersionedTable.upsert`` takes its current rows into
    gold when due. A replayed bronze batch is flagged again under the same ids and order.
    """
    changes = (
        spark.readStream.schema(bronze.stored_schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(bronze.path)
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        flagged = possible_fraud(batch.drop("batch_id", "_commit_ts"), scorer, threshold)
        fraud.write_batch(flagged, batch_id, seq=F.col("_seq"))

    return run(changes, handle, checkpoint, "detect_on_change", every)
