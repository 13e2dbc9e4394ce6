"""Keep-latest deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key: the one that is last by ``order`` (most significant first).

    ``order`` should be total within a key. The ``row_number = 1`` form lets Spark
    place a group limit before the shuffle, so a map task sends at most one row per
    key: a key holding a third of the table costs no more than any other.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def file_order(df: DataFrame) -> DataFrame:
    """Number the rows of a file scan in reading order as ``_file_order``.

    Files go by modification time and name; inside a file a split's start offset,
    then the row's place in the split. Must be applied directly to the scan.
    """
    return df.withColumn(
        "_file_order",
        F.struct(
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
