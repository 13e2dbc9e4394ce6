import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.changes import change_feed, with_previous
from ledgerlake.operators.dedup import keep_latest
from ledgerlake.operators.merge import merge
from ledgerlake.schemas import table
from ledgerlake.sources.tables import ChangeLog

SCHEMA = table(_id="string", x="long", y="string")


def history(n=400, seed=1):
    """Batches of rows, a third of them under one key; some repeat what was there."""
    rnd = random.Random(seed)
    return [
        ("hot" if rnd.random() < 0.35 else f"k{rnd.randrange(40)}", rnd.choice([1, 2, None]), rnd.choice(["a", None]), seq)
        for seq in range(n)
    ]


def slow_feed(data):
    out, last = [], {}
    for key, x, y, seq in sorted(data, key=lambda r: r[3]):
        if key not in last or last[key] != (x, y):
            out.append((seq, "update" if key in last else "insert", key, last.get(key), (x, y)))
        last[key] = (x, y)
    return sorted(out, key=repr)


def flat(feed):
    pair = {s: F.when(F.col(s).isNotNull(), F.struct(f"{s}.x", f"{s}.y")) for s in ("before", "after")}
    got = feed.select(F.col("_seq").cast("long"), "kind", "_id", pair["before"].alias("b"), pair["after"].alias("a")).collect()
    return sorted(((r[0], r[1], r[2], tuple(r[3]) if r[3] else None, tuple(r[4])) for r in got), key=repr)


def test_feed_against_plain_loop(spark):
    data = history()
    df = spark.createDataFrame(data, "_id string, x long, y string, _seq long").repartition(5)
    assert flat(change_feed(df, "_id", ["_seq"], SCHEMA.names)) == slow_feed(data)


def test_a_hot_key_spreads_over_ranges(spark):
    data = [("hot", i // 2, "a", i) for i in range(4000)] + [(f"k{i}", 0, "a", i) for i in range(50)]
    df = spark.createDataFrame(data, "_id string, x long, y string, _seq long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        told = with_previous(df, "_id", ["_seq"], ["x"])
        got = told.where("_id = 'hot'").orderBy("_seq").select("before.x").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r[0] for r in got] == [None, *[i // 2 for i in range(3999)]]
    assert told.columns == ["_id", "x", "y", "_seq", "before"]


@pytest.fixture
def log(spark, path):
    made = ChangeLog(path("log"), SCHEMA)
    data = history()
    for batch in range(4):
        part = spark.createDataFrame(data[batch * 100 : batch * 100 + 100], "_id string, x long, y string, _seq long")
        made.write_batch(part, batch, seq=F.col("_seq"))
    return made, data


def test_log_feed_since(spark, log):
    made, data = log
    assert flat(made.changes(spark)) == slow_feed(data)
    assert flat(made.changes(spark, since=1)) == [c for c in slow_feed(data) if c[0] >= 200]
    assert made.changes(spark, since=3).count() == 0


def test_stale_rows_change_nothing(spark, log):
    made, _ = log
    made.write_batch(spark.createDataFrame([("hot", 99, "old", 3), ("new", 1, "a", 4)], "_id string, x long, y string, _seq long"), 9, seq=F.col("_seq"))
    assert [c[1:3] for c in flat(made.changes(spark, since=3))] == [("insert", "new")]


def test_a_reload_changes_nothing(spark, path):
    made = ChangeLog(path("log"), SCHEMA)
    batch = spark.createDataFrame([("a", 1, None), ("b", None, "x")], SCHEMA)
    made.write_batch(batch, 1)
    made.write_batch(batch, 2)
    assert made.changes(spark, since=1).count() == 0 and made.changes(spark).count() == 2
    assert ChangeLog(path("none"), SCHEMA).changes(spark).count() == 0


def test_views_as_of_and_refreshed(spark, log):
    made, data = log
    for upto in (0, 2):
        want = {k: (x, y) for k, x, y, s in data if s < 100 * (upto + 1)}
        assert {r[0]: (r[1], r[2]) for r in made.view(spark, upto).collect()} == want
    plan = made.view(spark, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan
    stored = made.view(spark, 1)
    assert rows(made.refreshed(spark, stored, 1)) == rows(made.view(spark))
    assert rows(made.refreshed(spark, made.view(spark), 3)) == rows(made.view(spark))


def test_merge_takes_the_latest_of_repeated_keys(spark):
    target = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1), (None, 8, 1)], "_id string, x long, n long")
    source = spark.createDataFrame([("a", 7, 9), ("a", 6, 8), ("c", 3, 1), ("c", 4, 0), (None, 9, 1)], "_id string, x long, n long")
    got = merge(target, source, order="n", target_order="n")
    assert rows(got) == [("a", 7, 9), ("b", 5, 1), ("c", 3, 1)]


@pytest.mark.parametrize("side", ["target", "source"])
def test_merge_refuses_repeated_keys_without_an_order(spark, side):
    once = spark.createDataFrame([("a", 1)], "_id string, x long")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "_id string, x long")
    with pytest.raises(Exception, match=f"_id repeated in a {side}: a"):
        merge(*((twice, once) if side == "target" else (once, twice))).collect()


def test_merge_shuffles_each_side_once(spark):
    a = spark.range(50).select(F.col("id").cast("string").alias("_id"), "id")
    for got in (merge(a, a), merge(a, a, order="id", target_order="id")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    assert keep_latest(a, "_id", "id").count() == 50
