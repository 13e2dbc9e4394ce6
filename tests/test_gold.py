import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.scoring import FRAUD_THRESHOLD, flag_fraud, fraud_counts, pandas_scorer
from ledgerlake.plans import gold, silver, summary
from ledgerlake.schemas import (
    CUSTOMERS, GOLD_CUSTOMER_COLUMNS, GOLD_TRANSACTION_COLUMNS, PROFILES, SILVER_TRANSACTIONS, TRANSACTIONS,
)
from ledgerlake.sources.tables import ChangeLog, VersionedTable


@pytest.fixture
def customers(spark):
    text = {c: F.concat(F.lit(c[:2]), F.col("id")) for c in CUSTOMERS.names}
    text["county"] = F.when(F.col("id") % 2 == 0, "Kent").otherwise("Nowhere At All")
    text["country_code"] = F.when(F.col("id") % 3 == 0, "GB").otherwise("ZZ")
    return spark.range(30).select([v.alias(k) for k, v in text.items()])


@pytest.fixture
def refined(spark, customers):
    countries = spark.createDataFrame([("GB", "United Kingdom")], "country_code string, country string")
    subdivisions = spark.createDataFrame([("GB-KEN", "Kent")], "code string, name string")
    return silver.refine_customers(customers, countries, subdivisions)


@pytest.fixture
def transactions(spark):
    return spark.range(500).select(
        F.concat(F.lit("t"), "id").alias("_id"), F.lit("S").alias("sender_account"),
        F.lit("R").alias("receiver_account"), (F.col("id") / 4).alias("amount"),
        (F.col("id") * 86400.0).alias("transaction_date"),
    )


def test_refined_customers(refined):
    assert refined.count() == 30
    assert rows(refined.select("birthdate", "current_location").distinct()) == [("********", "****")]
    assert rows(refined.groupBy("country").count()) == [("United Kingdom", 10), ("not found", 20)]
    assert rows(refined.groupBy("iso3166_2").count()) == [("GB-KEN", 15), (None, 15)]


def test_old_key_name_and_account_mask(spark, customers):
    countries = spark.createDataFrame([], "country_code string, country string")
    subdivisions = spark.createDataFrame([("GB-KEN", "Kent")], "code string, name string")
    got = silver.refine_customers(
        customers.withColumnRenamed("_id", "id"), countries, subdivisions, not_found="?", mask_account=2
    )
    assert got.where("country <> '?' or not endswith(account_number, '**')").isEmpty()
    assert got.where("_id is null").isEmpty()


def test_gold_customers(spark, refined):
    profiles = spark.createDataFrame([("_i0", "46"), ("_i1", "n/a"), ("nobody", "9")], "_id string, score string")
    got = gold.gold_customers(refined, profiles)
    assert tuple(got.columns) == GOLD_CUSTOMER_COLUMNS
    assert got.count() == refined.count()
    scores = dict(got.select("_id", "score").collect())
    assert (scores["_i0"], scores["_i1"], scores["_i2"]) == (46, None, 0)


@pytest.fixture
def tables(spark, path, refined, transactions):
    bronze = ChangeLog(path("bronze"), TRANSACTIONS)
    bronze.write_batch(transactions, 0)
    profiles = ChangeLog(path("profiles"), PROFILES)
    profiles.write_batch(spark.createDataFrame([("_i0", 46)], PROFILES), 0)
    people, moves = VersionedTable(path("silver-c")), VersionedTable(path("silver-t"), SILVER_TRANSACTIONS)
    people.upsert(refined, mode="replace")
    moves.upsert(silver.refine_transactions(transactions), mode="replace")
    return bronze, people, profiles, moves, VersionedTable(path("gold-c")), VersionedTable(path("gold-t"))


def flags(spark, tables):
    return tables[5].read(spark).where("fraud").count()


def test_detection_then_consolidation_resets_or_keeps_flags(spark, tables, transactions):
    bronze, *silver_and_gold = tables
    gold.consolidate(spark, *silver_and_gold)
    assert flags(spark, tables) == 0
    fraud, valid = gold.detect_fraud(spark, bronze, tables[5])
    assert 0 < fraud == flags(spark, tables) and fraud + valid == transactions.count()
    assert gold.detect_fraud(spark, bronze, tables[5]) == (fraud, valid)
    after = tables[5].read(spark)
    assert set(after.columns) == set(GOLD_TRANSACTION_COLUMNS)
    assert after.count() == 500 and after.where("category is null").isEmpty()
    gold.consolidate(spark, *silver_and_gold, preserve_flags=True)
    assert flags(spark, tables) == fraud
    gold.consolidate(spark, *silver_and_gold)
    assert flags(spark, tables) == 0


def test_detection_first_inserts_without_category(spark, tables):
    fraud, _ = gold.detect_fraud(spark, tables[0], tables[5])
    assert tables[5].read(spark).count() == fraud
    gold.consolidate(spark, *tables[1:])
    assert tables[5].read(spark).where("category is null").isEmpty()


def test_empty_input_stops_before_any_write(spark, path, tables):
    bronze, people, _, moves, gold_c, gold_t = tables
    with pytest.raises(ValueError):
        gold.consolidate(spark, people, ChangeLog(path("none"), PROFILES), moves, gold_c, gold_t)
    assert not gold_c.exists(spark) and not gold_t.exists(spark)


def test_flagged_rows_are_above_the_threshold(transactions):
    scored = flag_fraud(transactions, gold.FRAUD_SCORER)
    assert scored.where(F.col("fraud") != (F.col("score") > FRAUD_THRESHOLD)).isEmpty()
    assert gold.possible_fraud(transactions).count() == scored.where("score > 85").count()
    counts = fraud_counts(scored).first()
    assert sum(counts) == 500


def test_model_hook(spark, transactions):
    seen = pandas_scorer(lambda b: pd.Series(b["amount"] * 4 % 101), ["amount"])
    assert gold.possible_fraud(transactions, seen, 99).count() == 4
    assert seen(transactions).schema["score"].dataType.simpleString() == "bigint"


def test_summaries(spark, transactions):
    table = gold.gold_transactions(silver.refine_transactions(transactions))
    total = summary.by_category(table).agg(F.sum("transactions"), F.sum("total_amount")).first()
    assert total[0] == 500 and total[1] == pytest.approx(sum(i / 4 for i in range(500)), abs=0.01 * 500)
    rolled = summary.by_category_and_month(table)
    grand = rolled.where("category is null and month is null").first()
    assert grand.transactions == 500 and grand.fraud == 0
    assert rolled.where("month = '1970-01'").agg(F.sum("transactions")).first()[0] == 31
