"""Tier, topic and consumer metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lag_seconds, published_count
from ..schemas import METRIC_RECORD, METRICS


def tier_counts(
    tables: Mapping[tuple[str, str], DataFrame], at: Column | None = None
) -> DataFrame:
    """``tier, series, value`` for each table given under its (tier, series).

    A count needs no column, so a plain Parquet table is counted from its footers.
    ``at``, such as ``current_timestamp()``, is added as ``ts``.
    """
    counts = [
        df.agg(F.count("*").alias("value")).select(
            F.lit(tier).alias("tier"), F.lit(series).alias("series"), "value"
        )
        for (tier, series), df in tables.items()
    ]
    together = reduce(DataFrame.unionByName, counts)
    return together if at is None else together.withColumn("ts", at)


def gold_counts(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Gold rows and reported fraud; the transactions are read once for both."""
    both = transactions.agg(
        F.count("*").alias("transactions"), F.count_if("fraud").alias("fraud_activity")
    ).unpivot([], ["transactions", "fraud_activity"], "series", "value")
    return tier_counts({("gold", "customers"): customers}).unionByName(
        both.select(F.lit("gold").alias("tier"), "series", "value")
    )


def topic_progress(cursors: DataFrame) -> DataFrame:
    """Messages published per partition, and processed by every consumer group.

    ``cursors`` has ``partitionid, produceroffset, committedoffset`` per group.
    """
    return cursors.groupBy("partitionid").agg(
        published_count(F.max("produceroffset")).alias("published"),
        F.min("committedoffset").alias("processed"),
    )


def consumer_lag(cursors: DataFrame) -> DataFrame:
    """Seconds and offsets each group is behind, per partition."""
    return cursors.groupBy("consumergroup", "partitionid").agg(
        F.max(lag_seconds("consumerlagmillis")).alias("lag_s"),
        (published_count(F.max("produceroffset")) - F.max("committedoffset")).alias("offsets_behind"),
    )


def as_series(lag: DataFrame) -> DataFrame:
    """Consumer lag as named series with whole-number values, for a chart."""
    name = F.concat_ws("_", "consumergroup", F.col("partitionid").cast("string"))
    pairs = F.create_map(
        F.concat(name, F.lit("_lag(s)")),
        F.col("lag_s").cast("double"),
        F.concat(name, F.lit("_offsetBehind")),
        F.col("offsets_behind").cast("double"),
    )
    return flatten_series(lag.select(pairs.alias("values")))


def flatten_series(df: DataFrame, values: str = "values", prefix: str | None = None) -> DataFrame:
    """Maps of series to value as rows ``series, value``; values are cut to whole numbers."""
    rows = df.select(F.explode(values).alias("series", "value"))
    series = F.concat(F.lit(f"{prefix}_"), F.col("series")) if prefix else F.col("series")
    return rows.select(series.alias("series"), F.col("value").cast("bigint").alias("value"))


def metric_row(counters: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``metric, value`` rows as one row with a column per named metric."""
    return counters.groupBy().pivot("metric", list(metrics)).agg(F.first("value"))


def snapshot(counts: DataFrame, progress: DataFrame) -> DataFrame:
    """All counters in one row, from ``tier_counts`` with gold, and ``topic_progress``."""
    series = F.replace("series", F.lit("fraud_activity"), F.lit("fraud"))
    tiers = counts.select(F.concat_ws("_", "tier", series).alias("metric"), "value")
    topic = progress.agg(
        F.max("published").alias("transactions_ingested"),
        F.min("processed").alias("transactions_processed"),
    ).unpivot([], ["transactions_ingested", "transactions_processed"], "metric", "value")
    return metric_row(tiers.unionByName(topic))


def watched_metrics(
    messages: DataFrame, names: Sequence[str], value: str = "value", timestamp: str = "timestamp"
) -> DataFrame:
    """From metric messages (a JSON array each), the first record if its name is watched.

    Works on a batch and on a stream of topic records.
    """
    first = F.try_element_at(F.from_json(F.col(value).cast("string"), METRIC_RECORD), F.lit(1))
    return (
        messages.withColumn("_m", first)
        .where(F.col("_m.metric").isin(*names))
        .select(
            F.col("_m.tags.clustername").alias("name"),
            F.date_format(timestamp, "HH:mm:ss").alias("time"),
            F.col("_m.metric").alias("series"),
            F.col("_m.value").alias("value"),
        )
    )
