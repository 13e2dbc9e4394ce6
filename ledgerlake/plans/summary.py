"""Consolidated summaries of gold for reporting. A group may hold one customer only; give ``least`` to leave such groups out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _money() -> list[Column]:
    """Sums run over whole cents, so their result does not depend on the row order."""
    cents = F.sum(F.round(F.col("amount") * 100).cast("bigint"))
    n = F.count("amount")
    return [
        F.count("*").alias("transactions"),
        (cents.cast("double") / 100).alias("total_amount"),
        (cents.cast("double") / 100 / n).alias("average_amount"),
        F.count_if("fraud").alias("fraud"),
    ]


def with_month(transactions: DataFrame) -> DataFrame:
    """Add ``month`` (yyyy-MM, UTC) from the epoch seconds."""
    days = F.floor(F.col("transaction_date") / 86400).cast("int")
    return transactions.withColumn("month", F.date_format(F.date_from_unix_date(days), "yyyy-MM"))


def by_category(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("category").agg(*_money())


def by_category_and_month(transactions: DataFrame) -> DataFrame:
    """Totals per category and month, per category, and over all."""
    return with_month(transactions).rollup("category", "month").agg(*_money())


def by_country(customers: DataFrame, least: int = 1) -> DataFrame:
    """Totals per country with ``least`` customers or more."""
    totals = customers.groupBy("country").agg(
        F.count("*").alias("customers"),
        F.sum("score").alias("total_score"),
        F.count_if(F.col("score") > 85).alias("high_scores"),
    )
    return totals.where(F.col("customers") >= least)


def monthly_trend(transactions: DataFrame) -> DataFrame:
    """Per category and month: count, cents, change against the month and the year before, and three-month means.

    Frames are ranges of months, so a month without transactions is a gap and not skipped: what
    is compared with it is null, and a mean is that of the months that are there.
    """
    day = F.date_from_unix_date(F.floor(F.col("transaction_date") / 86400).cast("int"))
    cents = F.sum(F.round(F.col("amount") * 100).cast("bigint"))
    months = transactions.groupBy("category", (F.year(day) * 12 + F.month(day) - 1).alias("at")).agg(
        F.count("*").alias("transactions"), cents.alias("cents"), F.count_if("fraud").alias("fraud")
    )
    series = Window.partitionBy("category").orderBy("at")

    def back(n: int) -> Column:
        return F.sum("cents").over(series.rangeBetween(-n, -n))

    return months.select(
        "category", F.format_string("%04d-%02d", F.floor(F.col("at") / 12), F.col("at") % 12 + 1).alias("month"),
        "transactions", "cents", "fraud",
        (F.col("cents") - back(1)).alias("month_change"),
        (F.col("cents") - back(12)).alias("year_change"),
        F.avg("cents").over(series.rangeBetween(-2, 0)).alias("mean_3"),
        F.sum("transactions").over(series.rangeBetween(Window.unboundedPreceding, 0)).alias("so_far"),
    )


def by_any_of(transactions: DataFrame) -> DataFrame:
    """Counts and cents by category, month and flag, in every combination; ``level`` has a bit per column left out."""
    cents = F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents")
    return with_month(transactions).cube("category", "month", "fraud").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("transactions"), cents
    )


#: Buckets of a distinct sketch, as a power of two: a relative error of about 1.6 %.
SKETCH_BITS = 12


def daily_sketches(transactions: DataFrame, of: str) -> DataFrame:
    """A mergeable sketch of the distinct values of ``of`` per category and day; stored, it need not be made again."""
    day = F.date_from_unix_date(F.floor(F.col("transaction_date") / 86400).cast("int"))
    return transactions.groupBy("category", day.alias("day")).agg(F.hll_sketch_agg(of, SKETCH_BITS).alias("sketch"))


def monthly_reach(sketches: DataFrame) -> DataFrame:
    """About how many distinct values a category had in a month, from its days' sketches alone."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    return sketches.groupBy("category", month).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about")
    )
