import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.dedup import keep_latest
from ledgerlake.operators.merge import merge
from ledgerlake.schemas import table
from ledgerlake.sources.tables import ChangeLog, DeadLetters, VersionedTable, require_rows

SCHEMA = table(_id="string", v="long", w="string")


def frame(spark, data, columns="_id string, v bigint, w string, n bigint"):
    return spark.createDataFrame(data, columns)


def test_missing_log_reads_as_empty(spark, path):
    log = ChangeLog(path("log"), SCHEMA)
    assert log.is_empty(spark) and log.current(spark).columns == SCHEMA.names


def test_a_replayed_batch_replaces_itself_only(spark, path):
    log = ChangeLog(path("log"), SCHEMA)
    log.write_batch(frame(spark, [("a", 1, "x", 1), ("b", 1, "x", 2)]), 0, seq=F.col("n"))
    log.write_batch(frame(spark, [("a", 2, "y", 3)]), 1, seq=F.col("n"))
    before = rows(log.current(spark))
    log.write_batch(frame(spark, [("a", 2, "y", 3)]), 1, seq=F.col("n"))
    assert rows(log.current(spark)) == before == [("a", 2, "y"), ("b", 1, "x")]
    assert log.rows(spark).count() == 3


def test_source_order_beats_batch_order(spark, path):
    log = ChangeLog(path("log"), SCHEMA)
    log.write_batch(frame(spark, [("a", 2, "late", 9)]), 0, seq=F.col("n"))
    log.write_batch(frame(spark, [("a", 1, "early", 4)]), 1, seq=F.col("n"))
    assert rows(log.current(spark)) == [("a", 2, "late")]


def test_rows_without_key_stay_out(spark, path):
    log = ChangeLog(path("log"), SCHEMA)
    log.write_batch(frame(spark, [(None, 1, "x", 1), ("a", 1, "x", 1)]), 0)
    assert log.rows(spark).count() == 1


def test_patched_view_takes_the_latest_cell_of_each_column(spark, path):
    log = ChangeLog(path("log"), SCHEMA)
    log.write_batch(frame(spark, [("a", 1, "x", 1), ("b", None, None, 1)]), 0, seq=F.col("n"))
    log.write_batch(frame(spark, [("a", None, "y", 2)]), 1, seq=F.col("n"))
    log.write_batch(frame(spark, [("a", 3, None, 3)]), 2, seq=F.col("n"))
    assert rows(log.current_patched(spark)) == [("a", 3, "y"), ("b", None, None)]


def test_history(spark, path):
    log = ChangeLog(path("log"), SCHEMA)
    when = F.lit("2024-01-02 03:04:05")
    for batch in range(3):
        log.write_batch(
            frame(spark, [("a", batch, "x", batch), (f"k{batch}", 0, "y", batch)]),
            batch, seq=F.col("n"), commit_ts=when,
        )
    assert rows(log.history(spark)) == [("2024-01-02 03:04:05", b, 2) for b in range(3)]


def test_an_empty_replay_clears_its_batch(spark, path):
    log, letters = ChangeLog(path("log"), SCHEMA), DeadLetters(path("dead"))
    some = frame(spark, [("a", 1, "x", 0), ("b", 2, "y", 0)])
    log.write_batch(some, 1, seq=F.col("n"))
    log.write_batch(some, 2, seq=F.col("n"))
    bad = spark.createDataFrame([("damaged", "x", "s")], "reason string, raw string, source string")
    letters.write(bad, 1)
    log.write_batch(some.limit(0), 1, seq=F.col("n"))
    letters.write(bad.limit(0), 1)
    assert log.rows(spark).where("batch_id = 1").isEmpty() and log.rows(spark).count() == 2
    assert letters.read(spark).isEmpty()


def test_repeated_and_missing_keys_never_reach_a_version(spark, path):
    table = VersionedTable(path("t"), SCHEMA)
    twice = frame(spark, [("a", 1, "x", 0), ("a", 2, "y", 1)])
    with pytest.raises(Exception, match="repeated"):
        table.upsert(twice.drop("n"))
    for _ in range(2):
        table.upsert(twice, order="n", mode="replace")
    assert [r["_id"] for r in table.read(spark).collect()] == ["a"]
    keyless = frame(spark, [(None, 1, "x", 0), ("b", 2, "y", 1)]).drop("n")
    with pytest.raises(Exception, match="no _id"):
        table.upsert(keyless)
    letters = DeadLetters(path("dead"))
    table.upsert(keyless, dead=letters, batch_id=3)
    assert [r["reason"] for r in letters.read(spark).collect()] == ["missing key"]
    assert sorted(r["_id"] for r in table.read(spark).collect()) == ["a", "b"]


def test_the_first_version_has_the_declared_columns(spark, path):
    table = VersionedTable(path("t"), SCHEMA)
    table.upsert(frame(spark, [("a", 1, "x", 0)]).select("_id"))
    assert table.read(spark).columns == SCHEMA.names


def test_the_whole_message_is_kept(spark, path):
    log = ChangeLog(path("raw"), SCHEMA, keep_raw=True)
    log.write_batch(frame(spark, [("a", 1, "x", 0)]).withColumn("_raw", F.lit("{...}")), 1)
    assert [r["_raw"] for r in log.rows(spark).collect()] == ["{...}"]
    assert log.current(spark).columns == SCHEMA.names


def test_versions(spark, path):
    gold = VersionedTable(path("gold"), SCHEMA)
    assert not gold.exists(spark) and gold.read(spark).isEmpty()
    gold.upsert(frame(spark, [("a", 1, "x", 0)]).drop("n"))
    gold.upsert(frame(spark, [("a", 2, None, 0), ("b", 3, "z", 0)]).drop("n"), mode="patch")
    assert rows(gold.read(spark)) == [("a", 2, "x"), ("b", 3, "z")]
    assert [r.id for r in gold.history(spark).orderBy("id").collect()] == [1, 2]
    assert "/v2-" in gold.location(spark)


def test_an_unfinished_version_is_not_read(spark, path):
    gold = VersionedTable(path("gold"), SCHEMA)
    gold.upsert(frame(spark, [("a", 1, "x", 0)]).drop("n"))
    frame(spark, [("broken", 0, "", 0)]).write.parquet(path("gold") + "/v2-broken")
    assert rows(gold.read(spark)) == [("a", 1, "x")]
    gold.upsert(frame(spark, [("b", 2, "y", 0)]).drop("n"))
    assert rows(gold.read(spark)) == [("a", 1, "x"), ("b", 2, "y")]


def test_real_errors_are_raised(spark, path):
    gold = VersionedTable(path("gold"), SCHEMA)
    gold.upsert(frame(spark, [("a", 1, "x", 0)]).drop("n"))
    bad = spark.createDataFrame([("a", "not a number")], "_id string, v string")
    with pytest.raises(PySparkException):
        gold.upsert(bad)
    assert rows(gold.read(spark)) == [("a", 1, "x")]


def test_guard(spark, path):
    log, gold = ChangeLog(path("log"), SCHEMA), VersionedTable(path("gold"), SCHEMA)
    log.write_batch(frame(spark, [("a", 1, "x", 1)]), 0)
    with pytest.raises(ValueError, match="gold"):
        require_rows(spark, log, gold)
    gold.upsert(log.current(spark))
    require_rows(spark, log, gold)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def files_in(location):
    return [f for f in os.listdir(location) if f.endswith(".parquet")]


def test_bucketed_table_is_merged_in_place(no_broadcast, path):
    spark = no_broadcast
    silver = VersionedTable(path("silver"), buckets=3)
    gold = VersionedTable(path("gold"), buckets=3)
    rows_of = lambda low, high, v: spark.range(low, high).selectExpr("cast(id as string) _id", f"{v} as v")
    silver.upsert(rows_of(0, 900, 1))
    silver.upsert(rows_of(600, 1200, 2))
    got = dict(silver.read(spark).collect())
    assert len(got) == 1200 and got["599"] == 1 and got["600"] == got["1199"] == 2
    assert len(files_in(silver.location(spark))) == 3

    gold.upsert(rows_of(0, 300, 0))
    assert gold.same_buckets(silver) and not gold.same_buckets(VersionedTable(path("x"), buckets=4))
    joined = merge(gold.read(spark), silver.read(spark))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    gold.upsert(silver.read(spark), clustered=True)
    assert rows(gold.read(spark)) == rows(silver.read(spark))
    assert len(files_in(gold.location(spark))) == 3


def test_source_of_many_partitions_does_not_move_the_target(no_broadcast, path):
    spark = no_broadcast
    gold = VersionedTable(path("gold"), buckets=2)
    gold.upsert(spark.range(500).selectExpr("cast(id as string) _id", "id v"))
    source = keep_latest(spark.range(400, 700).selectExpr("cast(id as string) _id", "id + 1 v"), "_id", "v")
    merged = merge(gold.read(spark), source.repartition(2, "_id"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning(t_" not in plan
    gold.upsert(source)
    assert gold.read(spark).where("v = cast(_id as bigint) + 1").count() == 300
    assert gold.read(spark).count() == 700


def test_buckets_are_known_to_a_new_session(spark, path):
    VersionedTable(path("t"), buckets=2).upsert(spark.range(9).selectExpr("cast(id as string) _id"))
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("v1_")]:
        spark.sql(f"DROP TABLE {name}")
    assert VersionedTable(path("t"), buckets=2).read(spark).count() == 9
