"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text, the same in each run; equal rows share it."""
    return F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col))


def row_words(id_col: str, text_col: str) -> list[Column]:
    """128 bits of hash of a row's id and text, as two numbers; a null differs from an empty text."""
    told = [F.col(c) for c in (id_col, text_col)]
    return [F.xxhash64(F.lit(w), *[c.isNull() for c in told], *told) for w in (18, 19)]


def numbered(rows: DataFrame, group: str, order: list[str], name: str, block_rows: int = 50_000) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, without one task per group.

    Rows are dealt to blocks by hash; a block starts where the counts of the blocks
    before it end. Rows equal in all of ``order`` get numbers in any order.
    """
    total = rows.count()
    blocks = max(1, -(-total // block_rows))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_block").orderBy(*order)
    placed = dealt.join(starts, [group, "_block"])
    number = (F.col("_start") + F.row_number().over(within) - 1).cast("long")
    return placed.withColumn(name, number).drop("_block", "_start")


def in_order(rows: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """Gapless numbers from 0 in the given order, of all rows or within each ``group``.

    Rows are dealt out by ranges of (group, order), so that neither a large group nor all rows
    meet in one task; a range goes on from the counts of the ranges before it. Rows equal in
    the order are numbered as they lie in the table. ``group`` must not be null.
    """
    keys = [group] if group else []
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = told.repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id())
    placed = materialize(ranges, "ranges")
    within = Window.partitionBy("_range", *keys).orderBy(*order, "_tie")
    numbers = placed.withColumn("_within", F.row_number().over(within) - 1)
    counts = placed.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a range or group that goes on from nothing needs no row
    starts = counts.select("_range", *keys, F.sum("_n").over(earlier).alias("_start")).filter("_start > 0")
    joined = numbers.join(materialize(starts, "range-starts"), ["_range", *keys], "left")
    number = (F.coalesce("_start", F.lit(0)) + F.col("_within")).cast("long")
    return joined.withColumn(name, number).drop("_tie", "_range", "_within", "_start")
