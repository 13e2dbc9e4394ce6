"""Equi-join lookups. No side is broadcast by hint: Spark's size threshold decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def account_owners(customers: DataFrame) -> DataFrame:
    """``account_number, customer_id``; a shared account goes to the smallest id."""
    return (
        customers.where(F.col("account_number").isNotNull())
        .groupBy("account_number")
        .agg(F.min("_id").alias("customer_id"))
    )


def resolve_customers(df: DataFrame, owners: DataFrame, account: str) -> DataFrame:
    """Add ``customer_id`` for ``account``; rows whose account is unknown drop out.

    ``owners`` comes from ``account_owners``. For a join over all transactions store it
    first (``session.materialize`` or a table): read from files it is broadcast when
    small, and otherwise both sides reach the sort-merge join straight from a shuffle,
    where Spark splits the partition of an account that holds a large share of rows.
    """
    return df.join(owners.withColumnRenamed("account_number", account), account, "inner")


def add_country(
    df: DataFrame, countries: DataFrame, code: str = "country_code", not_found: str = "not found"
) -> DataFrame:
    """Add the ``country`` name of a two-letter code, or the ``not_found`` text.

    Of several names for a code the smallest counts, so no customer is multiplied. The
    reduced names are stored, so that Spark sees their size and can split a hot country.
    """
    reduced = countries.groupBy(F.col("country_code").alias(code)).agg(F.min("country").alias("country"))
    names = materialize(reduced, "country-names")
    return df.join(names, code, "left").withColumn(
        "country", F.coalesce(F.col("country"), F.lit(not_found))
    )
