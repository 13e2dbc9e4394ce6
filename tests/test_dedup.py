import random

from conftest import rows
from ledgerlake.operators.dedup import file_order, keep_latest


def test_last_row_wins_and_null_order_loses(spark):
    df = spark.createDataFrame(
        [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", None, "x"), ("b", 0, "y")],
        "k string, n int, v string",
    )
    assert rows(keep_latest(df, "k", "n")) == [("a", 3, "new"), ("b", 0, "y")]


def test_ties_go_to_the_second_order_column(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("a", 0, 99)], "k string, n int, m int")
    assert rows(keep_latest(df, ["k"], ["n", "m"])) == [("a", 1, 9)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(500)}", i, rng.random()) for i in range(6000)]
    df = spark.createDataFrame(data, "k string, n int, v double").repartition(4)
    latest = keep_latest(df, "k", "n")
    want = {}
    for k, n, v in data:
        want[k] = (k, n, v)
    assert rows(latest) == sorted(want.values(), key=repr)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    below_last_exchange = plan[plan.index("hashpartitioning(k"):]
    assert "WindowGroupLimit" in below_last_exchange and "Partial" in below_last_exchange


def test_file_order_follows_lines_across_splits(spark, path):
    lines = [f"{i % 50},{i:06d}" for i in range(20000)]
    target = path("in.csv")
    with open(target, "w") as f:
        f.write("k,v\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = spark.read.csv(target, header=True)
        assert df.rdd.getNumPartitions() > 4
        got = dict(keep_latest(file_order(df), "k", "_file_order").select("k", "v").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {str(k): f"{19950 + k:06d}" for k in range(50)}
