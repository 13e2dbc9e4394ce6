"""The entities as views over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import padded
from ..operators.dedup import keep_latest


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_seconds(c: str):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(c))
    return micros.cast("double") / 1_000_000


def account(key) -> F.Column:
    return F.concat(F.lit("ACC"), padded(key, 10))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customers; every other county carries a spelling error."""
    key = F.col("c_custkey").cast("string")
    nations = load(spark, sf_dir, "nation")
    county = F.concat(
        F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))),
        F.when(F.col("n_nationkey") % 2 == 1, "x").otherwise(""),
    )
    return (
        load(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("_id"),
            F.col("c_name").alias("name"),
            F.lit("1970-01-01").alias("birthdate"),
            F.lit("(0, 0)").alias("current_location"),
            F.concat(key, F.lit("@example.com")).alias("mail"),
            F.concat(F.lit("user"), key).alias("username"),
            F.concat(key, F.lit(" Main Street\nTown")).alias("address"),
            account(F.col("c_custkey")).alias("account_number"),
            F.concat(F.lit("SSN"), key).alias("ssn"),
            F.lit("O+").alias("blood_group"),
            F.col("c_mktsegment").alias("company"),
            F.lit("clerk").alias("job"),
            F.lit("X").alias("sex"),
            county.alias("county"),
            padded("n_regionkey", 2).alias("country_code"),
        )
    )


def transactions(
    spark: SparkSession, sf_dir: str, with_seq: bool = False, orders: DataFrame | None = None
) -> DataFrame:
    """Raw transactions; one receiver in ten is no customer. ``_seq`` is their order.

    ``orders`` may be some rows of the table of that name.
    """
    key = F.col("o_orderkey")
    rows = (load(spark, sf_dir, "orders") if orders is None else orders).select(
        key.cast("string").alias("_id"),
        account(key * 31 % 997).alias("sender_account"),
        F.when(key % 10 == 0, F.concat(F.lit("EXT"), key.cast("string")))
        .otherwise(account(F.col("o_custkey")))
        .alias("receiver_account"),
        F.round("o_totalprice", 2).alias("amount"),
        epoch_seconds("o_orderdate").alias("transaction_date"),
        key.alias("_seq"),
    )
    return rows if with_seq else rows.drop("_seq")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names by code, the last one missing."""
    regions = load(spark, sf_dir, "region")
    last = regions.agg(F.max("r_regionkey").alias("r_regionkey"))
    return regions.join(last, "r_regionkey", "left_anti").select(
        padded("r_regionkey", 2).alias("country_code"),
        F.col("r_name").alias("country"),
    )


def subdivisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(
        F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("code"),
        F.col("n_name").alias("name"),
    )


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer positions read off the event log: a group per event type, four partitions."""
    positions = (
        load(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("consumergroup"), (F.col("user_id") % 4).alias("partitionid"))
        .agg(F.max("event_id").alias("committedoffset"), F.max("ts").alias("seen"))
    )
    everyone = Window.partitionBy("partitionid")
    return positions.select(
        "consumergroup",
        "partitionid",
        F.timestamp_diff("MILLISECOND", F.col("seen"), F.max("seen").over(everyone)).alias(
            "consumerlagmillis"
        ),
        F.max("committedoffset").over(everyone).alias("produceroffset"),
        "committedoffset",
    )


# A total order over line items: the last line of an order by ship date, then the rest.
LINE_ORDER = [
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def line_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two document sets keyed by order, one from returned lines and one from the others.

    They share some keys and some columns; ``quantity`` is null for open lines.
    """
    lines = load(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    shared = [
        F.col("l_orderkey").cast("string").alias("_id"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_linestatus") != "O", F.col("l_quantity")).alias("quantity"),
    ]
    target = keep_latest(lines.where(~returned), "l_orderkey", LINE_ORDER)
    source = keep_latest(lines.where(returned), "l_orderkey", LINE_ORDER)
    return (
        target.select(*shared, F.col("l_linestatus").alias("status")),
        source.select(*shared, F.col("l_tax").alias("tax")),
    )
