from datetime import datetime, timezone

from pyspark.sql import functions as F

from ledgerlake.functions import scalar
from ledgerlake.schemas import CATEGORIES


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()[0]


def test_masks(spark):
    assert one(spark, scalar.mask_tail("c", 4), "GB12345678") == "GB1234****"
    assert one(spark, scalar.mask_tail("c", 4), "ab") == "****"
    assert one(spark, scalar.mask_tail("c", 4), None) is None
    assert one(spark, scalar.masked(8), None) == "********"


def test_one_line(spark):
    assert one(spark, scalar.one_line("c"), "a\r\nb\nc") == "a  b c"


def test_percentile_from_text(spark):
    assert one(spark, scalar.to_percentile("c"), "46") == 46
    assert one(spark, scalar.to_percentile("c"), "n/a") is None


def parse(spark, text):
    return one(spark, F.date_format(scalar.parse_iso_ampm("c"), "yyyy-MM-dd HH:mm:ss.SSS"), text)


def test_twelve_hour_clock(spark):
    assert parse(spark, "2024-06-01T09:30:00.250+0000 AM") == "2024-06-01 09:30:00.250"
    assert parse(spark, "2024-06-01T09:30:00.250+0000 PM") == "2024-06-01 21:30:00.250"
    # A naive "add twelve hours" would put noon on the next day and leave midnight at noon.
    assert parse(spark, "2024-06-01T12:05:00.000+0000 PM") == "2024-06-01 12:05:00.000"
    assert parse(spark, "2024-06-01T12:05:00.000+0000 AM") == "2024-06-01 00:05:00.000"
    assert parse(spark, "2024-06-01T01:00:00.000+02:00") == "2024-05-31 23:00:00.000"
    assert parse(spark, "yesterday PM") is None


def test_millis(spark):

    at = int(datetime(2024, 7, 1, 13, 4, 5, tzinfo=timezone.utc).timestamp() * 1000)
    assert one(spark, scalar.format_millis("c"), at, "bigint") == "2024-07-01 13:04:05"
    assert one(spark, scalar.format_clock("c"), at, "bigint") == "13:04:05"


def test_categories_are_stable_and_all_reachable(spark):
    keys = spark.range(3000)
    eleven = {r[0] for r in keys.select(scalar.pick_category("id")).distinct().collect()}
    ten = {r[0] for r in keys.select(scalar.pick_category("id", 10)).distinct().collect()}
    assert eleven == set(CATEGORIES) and ten == set(CATEGORIES[:10])


def test_scores_stay_in_range_and_differ_by_salt(spark):
    low, high, moved = (
        spark.range(5000)
        .select(scalar.hash_score("id").alias("a"), scalar.hash_score("id", "s:").alias("b"))
        .agg(F.min("a"), F.max("a"), F.count_if(F.col("a") != F.col("b")))
        .first()
    )
    assert (low, high) == (0, 100) and moved > 4500


def test_names_are_folded(spark):
    assert one(spark, scalar.fold_name("c"), "  ÎLE-de-Frãnce ") == "ile-de-france"


def test_padding_never_cuts(spark):
    assert one(spark, scalar.padded("c", 10), "12345678901") == "12345678901"
    assert one(spark, scalar.padded("c", 4), "7") == "0007"


def test_all_accents_are_folded(spark):
    assert one(spark, scalar.fold_name("c"), "Điện Biên") == "dien bien"
    assert one(spark, scalar.fold_name("c"), "Café ") == "cafe"
