"""Changes of keyed rows: what each row did to the one before it under its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_previous(
    rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str = "before"
) -> DataFrame:
    """Every row with a struct of ``columns`` of the row before it under its key; null for the first.

    Rows are dealt out by ranges of (key, order), so that a key with many rows spreads over
    several tasks; the last row of each range, one per range, is handed on to the next. Rows
    equal in the order follow a hash of their columns. ``key`` must not be null.
    """
    row = F.struct(*columns)
    ranges = rows.withColumn("_tie", F.xxhash64(*columns)).repartitionByRange(key, *order, "_tie")
    placed = materialize(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    last = F.max(F.struct(F.col(key).alias("key"), *order, "_tie", row.alias("row"))).alias("last")
    in_turn = Window.orderBy("_range")  # over a row per range
    ends = placed.groupBy("_range").agg(last).select("_range", F.lag("last").over(in_turn).alias("_handed"))
    own = Window.partitionBy("_range", key).orderBy(*order, "_tie")
    here = placed.withColumns({"_own": F.lag(row).over(own), "_place": F.row_number().over(own)})
    joined = here.join(materialize(ends, "range-ends"), "_range", "left")
    handed = F.when(F.col("_handed.key") == F.col(key), F.col("_handed.row"))
    before = F.when(F.col("_place") > 1, F.col("_own")).otherwise(handed)
    return joined.withColumn(name, before).drop("_tie", "_range", "_own", "_place", "_handed")


def change_feed(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``kind`` (insert, update), the key, its order, ``before`` and ``after`` of every change.

    A row equal to the one before it under its key, nulls included, is no change.
    """
    after = F.struct(*columns)
    kind = F.when(F.col("before").isNull(), "insert").when(~F.col("before").eqNullSafe(after), "update")
    told = with_previous(rows, key, order, columns).select(kind.alias("kind"), key, *order, "before", after.alias("after"))
    return told.where(F.col("kind").isNotNull())
