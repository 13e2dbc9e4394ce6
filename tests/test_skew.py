"""One key holding a third of all rows, with joins too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.fuzzy import add_subdivision, match_subdivisions
from ledgerlake.operators.lookup import account_owners, add_country, resolve_customers
from ledgerlake.plans.profiles import latest_profiles
from ledgerlake.session import materialize

N = 120_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def sort_merge_only(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture
def transactions(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, N, 1, 8).select(
        F.concat(F.lit("t"), "id").alias("_id"),
        F.when(hot, "ACC7").otherwise(F.concat(F.lit("ACC"), F.col("id") % 1009)).alias("receiver_account"),
        F.col("id").alias("_seq"),
    )


@pytest.fixture
def customers(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, N, 1, 8).select(
        F.concat(F.lit("c"), "id").alias("_id"),
        F.concat(F.lit("ACC"), "id").alias("account_number"),
        F.when(hot, "Kent").otherwise(F.concat(F.lit("County "), F.col("id") % 211)).alias("county"),
        F.when(hot, "GB").otherwise(F.concat(F.lit("C"), F.col("id") % 97)).alias("country_code"),
    )


def final_plan(df):
    """Row count, and the plan as adapted at run time."""
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().toString()


def test_hot_account(sort_merge_only, transactions, customers):
    owners = materialize(account_owners(customers), "owners")
    n, plan = final_plan(resolve_customers(transactions, owners, "receiver_account"))
    assert n == N and "SortMergeJoin(skew=true)" in plan


def test_hot_country(sort_merge_only, customers):
    spark = sort_merge_only
    dim = materialize(
        spark.range(97).select(F.concat(F.lit("C"), "id").alias("country_code"), F.lit("x").alias("country"))
        .union(spark.sql("select 'GB', 'United Kingdom'")),
        "countries",
    )
    n, plan = final_plan(add_country(customers, dim))
    assert n == N and "SortMergeJoin(skew=true)" in plan


def test_hot_county(sort_merge_only, customers):
    spark = sort_merge_only
    dim = spark.range(211).select(
        F.concat(F.lit("S-"), "id").alias("code"), F.concat(F.lit("county "), "id").alias("name")
    ).union(spark.sql("select 'GB-KEN', 'Kent'"))
    matches = materialize(match_subdivisions(customers.select("county"), dim, 1), "matches")
    assert matches.count() == 212
    n, plan = final_plan(add_subdivision(customers.select("_id", "county"), matches))
    assert n == N and "SortMergeJoin(skew=true)" in plan


def test_hot_account_reaches_the_profile_join_as_one_row(sort_merge_only, transactions, customers):
    profiles = latest_profiles(transactions, account_owners(customers))
    n, plan = final_plan(profiles)
    assert n == 1009
    last_hot = (N - 1) // 3 * 3
    row = profiles.where("_id = 'c7'").first()
    assert row._seq >= last_hot
