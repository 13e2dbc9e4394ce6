import random

import pytest

from conftest import rows
from ledgerlake.operators.merge import merge, split_missing_keys

T = "_id string, a int, b string, t string"
S = "_id string, a int, b string, s string"


def make(spark):
    target = spark.createDataFrame(
        [("1", 1, "x", "t1"), ("2", 2, "y", "t2"), ("3", 3, None, "t3")], T
    )
    source = spark.createDataFrame([("2", 20, None, "s2"), ("4", 40, "w", None)], S)
    return target, source


def test_replace_drops_what_the_source_lacks(spark):
    assert rows(merge(*make(spark), mode="replace")) == [
        ("1", 1, "x", "t1", None), ("2", 20, None, None, "s2"),
        ("3", 3, None, "t3", None), ("4", 40, "w", None, None),
    ]


def test_update_keeps_target_columns_and_takes_source_nulls(spark):
    assert rows(merge(*make(spark), mode="update")) == [
        ("1", 1, "x", "t1", None), ("2", 20, None, "t2", "s2"),
        ("3", 3, None, "t3", None), ("4", 40, "w", None, None),
    ]


def test_patch_skips_source_nulls(spark):
    assert ("2", 20, "y", "t2", "s2") in rows(merge(*make(spark), mode="patch"))


def test_a_row_of_nulls_still_counts_as_present(spark):
    target = spark.createDataFrame([("1", 5, "x", "t")], T)
    source = spark.createDataFrame([("1", None, None, None)], S)
    assert rows(merge(target, source)) == [("1", None, None, "t", None)]


def test_rows_without_key_are_not_merged(spark):
    target, _ = make(spark)
    source = spark.createDataFrame([(None, 1, "x", "s"), ("9", 9, "z", "s")], S)
    assert merge(target, source).where("_id is null").isEmpty()
    good, bad = split_missing_keys(source)
    assert good.count() == 1 and bad.count() == 1


def test_older_source_does_not_win(spark):
    target = spark.createDataFrame([("1", 5, 10), ("2", 5, 10), ("3", 5, None)], "_id string, v int, _seq int")
    source = spark.createDataFrame(
        [("1", 6, 9), ("2", 6, 10), ("3", 6, 1), ("4", 6, 1)], "_id string, v int, _seq int"
    )
    assert rows(merge(target, source, newest_by="_seq")) == [
        ("1", 5, 10), ("2", 6, 10), ("3", 6, 1), ("4", 6, 1),
    ]


def test_source_takes_the_target_type(spark):
    target = spark.createDataFrame([("1", 5)], "_id string, v bigint")
    source = spark.createDataFrame([("1", 7.0)], "_id string, v double")
    merged = merge(target, source)
    assert merged.schema["v"].dataType.simpleString() == "bigint" and rows(merged) == [("1", 7)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        merge(*make(spark), mode="upsert")


@pytest.mark.parametrize("mode", ["replace", "update", "patch"])
def test_keys_stay_unique_and_repeats_change_nothing(spark, mode):
    rng = random.Random(7)

    def some(n, schema):
        ids = rng.sample(range(60), n)
        return spark.createDataFrame(
            [(str(i), rng.choice([None, rng.randrange(9)]), rng.choice([None, "p", "q"]), "z") for i in ids],
            schema,
        )

    target, source = some(40, T), some(40, S)
    once = merge(target, source, mode=mode)
    assert once.select("_id").distinct().count() == once.count()
    assert rows(merge(once, source, mode=mode)) == rows(once) or mode == "replace"
    assert once.count() == target.select("_id").union(source.select("_id")).distinct().count()
