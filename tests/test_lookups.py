import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.scoring import model_scorer
from ledgerlake.plans import gold, summary
from ledgerlake.schemas import TRANSACTIONS, table
from ledgerlake.sources import documents, files
from ledgerlake.sources.tables import ChangeLog


def scanned_rows(spark, df):
    """Rows that the file scan of a query gives, by its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.head()
    if "AdaptiveSparkPlan" in plan.nodeName():
        leaf = plan.executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_lookup_reads_one_row_group(spark, path):
    n = 200_000
    data = spark.range(n).select(F.format_string("k%08d", F.col("id") * 7919 % n).alias("_id"), F.rand(1).alias("x"), F.uuid().alias("y"))
    files.write_keyed(data, path("keyed"), "_id", group_bytes=1 << 20)
    stored = spark.read.parquet(path("keyed"))
    found = documents.find_by_key(stored, "_id", "k00012345")
    assert found.count() == 1
    assert 0 < scanned_rows(spark, documents.find_by_key(stored, "_id", "k00012345")) < n / 8
    assert documents.find_by_key(stored, "_id", "k00012345x").count() == 0
    # a key that is not there, though within the bounds of a row group: the filter spares the read
    assert scanned_rows(spark, documents.find_by_key(stored, "_id", "k00012345x")) == 0


def test_documents_of_any_shape(spark, path):
    texts = ['{"a": {"b": 1}}', '{"a": {"b": "x"}, "c": [1, 2]}', "[3]", "7", None, "", "{", '{"a": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")
    good, bad = documents.split_documents(df, "value")
    assert sorted(r.n for r in bad.collect()) == [4, 5, 6]
    good.write.parquet(path("docs"))
    docs = spark.read.parquet(path("docs"))
    got = docs.select("n", documents.at("doc", "$.a.b", "int").alias("b"), documents.at("doc", "$.c[1]", "long").alias("c"))
    assert rows(got) == [(0, 1, None), (1, None, 2), (2, None, None), (3, None, None), (7, None, None)]
    told = documents.fields(docs.where("n < 2")).first()
    assert told.documents == 2 and "a: OBJECT<b: VARIANT>" in told["shape"] and "c: ARRAY<BIGINT>" in told["shape"]
    assert documents.fields(docs.limit(0)).first().documents == 0


def test_a_model_is_loaded_once_in_a_task(spark, path):
    calls = path("calls")
    os.makedirs(calls)
    spark.createDataFrame([("2.5",)], "value string").coalesce(1).write.text(path("model"))

    def load(data):
        import uuid

        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return float(data)

    def predict(model, batch):
        return batch["x"] * model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        scorer = model_scorer(spark, path("model") + "/*.txt", load, predict, ["x"])
        df = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") % 5 != 0, F.col("id")).alias("x"))
        got = scorer(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(os.listdir(calls)) <= 4
    assert all(r.score is None if r.x is None else abs(r.score - 2.5 * r.x) <= 0.5 for r in got)
    assert scorer(df.limit(0)).count() == 0


def test_a_model_file_has_a_bound(spark, path):
    spark.createDataFrame([("x" * 100,)], "value string").coalesce(1).write.text(path("model"))
    with pytest.raises(ValueError, match="at most 50 bytes"):
        model_scorer(spark, path("model") + "/*.txt", bytes, lambda m, b: pd.Series(), ["x"], max_bytes=50)


def test_flags_are_rows_of_their_own(spark, path):
    scores = {"a": 90, "b": 10, "c": 99}

    def scorer(df):
        return df.withColumn("score", F.element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), F.col("_id")))

    bronze = ChangeLog(path("bronze"), TRANSACTIONS)
    flags = ChangeLog(path("flags"), table(_id="string", fraud="boolean"))

    def load(ids, batch):
        bronze.write_batch(spark.createDataFrame([(i, "s", "r", 1.0, 2.0) for i in ids], TRANSACTIONS), batch)
        gold.log_fraud(spark, bronze, flags, batch, since=batch - 1, scorer=scorer)

    load("ab", 1)
    load("c", 2)
    scores["a"] = 5
    load("a", 3)
    load("a", 4)  # nothing new
    assert [r.batch_id for r in flags.rows(spark).orderBy("batch_id").collect()] == [1, 2, 3]
    shown = gold.with_flags(gold.gold_transactions(bronze.current(spark)), flags)
    assert rows(shown.select("_id", "fraud")) == [("a", False), ("b", False), ("c", True)]


MONTH = 31 * 86_400


def test_trend_has_gaps(spark):
    data = [("x", 1.0, 0.0, False), ("x", 2.0, 1.0 * MONTH, True), ("x", 4.0, 3.2 * MONTH, None), (None, 1.0, 0.0, False)]
    df = spark.createDataFrame(data, "category string, amount double, transaction_date double, fraud boolean")
    got = {(r.category, r.month): r for r in summary.monthly_trend(df).collect()}
    assert sorted(m for c, m in got if c) == ["1970-01", "1970-02", "1970-04"]
    last = got["x", "1970-04"]
    assert last.month_change is None and last.mean_3 == 300.0 and last.so_far == 3
    assert got["x", "1970-02"].month_change == 100 and got["x", "1970-02"].fraud == 1
    assert summary.monthly_trend(df.limit(0)).count() == 0


def test_sketches_merge_to_the_true_number(spark):
    df = spark.range(60_000).select(
        F.lit("x").alias("category"), (F.col("id") % 20_000).cast("string").alias("who"),
        (F.col("id") % 28 * 86_400).cast("double").alias("transaction_date"),
    )
    about = summary.monthly_reach(summary.daily_sketches(df, "who")).first().about
    assert abs(about - 20_000) < 0.08 * 20_000
