import csv
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.plans import ingest
from ledgerlake.schemas import table
from ledgerlake.sources import files
from ledgerlake.sources.tables import ChangeLog, DeadLetters

SCHEMA = table(_id="string", name="string", amount="string")


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_every_value_is_text_and_quotes_are_doubled(spark, path):
    target = path("c.csv")
    with open(target, "w", newline="") as f:
        out = csv.writer(f)
        out.writerows([["_id", "name", "amount"], ["1", 'say "hi", Bob', "007"], ["2", " kept ", "1.50"]])
    got = files.read_csv_text(spark, target, SCHEMA).drop(files.DAMAGED)
    assert rows(got) == [("1", 'say "hi", Bob', "007"), ("2", " kept ", "1.50")]


def test_values_spanning_lines(spark, path):
    df = spark.createDataFrame([("1", "a\nb", 'x"y\\'), ("2", "", None)], SCHEMA)
    files.write_csv(df, path("out"))
    got = files.read_csv_text(spark, path("out"), SCHEMA, multi_line=True).drop(files.DAMAGED)
    assert rows(got) == [("1", "a\nb", 'x"y\\'), ("2", "", None)]


def test_written_files_are_bounded_and_keep_their_order(spark, path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_FILE", 3)
    df = spark.range(8).selectExpr("cast(id % 2 as string) as _id", "concat('a\\nb', id) as name", "'1' as amount")
    files.write_csv(df.coalesce(1), path("out"))
    assert len([f for f in os.listdir(path("out")) if f.startswith("part-")]) == 3
    log = ChangeLog(path("log"), SCHEMA)
    ingest.ingest_customers(spark, path("out"), log, 1, DeadLetters(path("dead")), multi_line=True)
    assert rows(log.current(spark)) == [("0", "a\nb6", "1"), ("1", "a\nb7", "1")]


def test_inferred_types(spark, path):
    target = write(path("c.csv"), "_id,name,amount\n1,a,2.5\n2,b,3\n")
    kinds = [f.dataType.simpleString() for f in files.read_csv_typed(spark, target).schema]
    assert kinds == ["int", "string", "double"]


def test_flow_dialect_trims_and_escapes(spark):
    line = spark.createDataFrame([(r'1, "a \"b\", c" ,  7 ',)], "line string")
    got = line.select(files.parse_csv_row("line", SCHEMA).alias("r")).select("r.*")
    assert rows(got) == [("1", 'a "b", c', "7")]


def test_customer_load_keeps_the_last_row_and_rejects_the_rest(spark, path):
    target = write(path("c.csv"), "_id,name,amount\n1,a,1\n2,b,2\n1,c,3\n,d,4\n5,e,5,6,7\n")
    log, letters = ChangeLog(path("bronze"), SCHEMA), DeadLetters(path("dead"))
    for batch in (1, 2):
        ingest.ingest_customers(spark, target, log, batch, letters)
    assert rows(log.current(spark)) == [("1", "c", "3"), ("2", "b", "2")]
    dead = letters.read(spark).where("batch_id = 2")
    assert sorted(r.reason for r in dead.collect()) == ["damaged", "missing key"]
    assert {"5,e,5,6,7"} <= {r.raw for r in dead.collect()}


def test_later_load_wins(spark, path):
    log = ChangeLog(path("bronze"), SCHEMA)
    first = write(path("1.csv"), "_id,name,amount\n1,a,1\n2,b,2\n")
    second = write(path("2.csv"), "_id,name,amount\n2,new,9\n3,c,3\n")
    letters = DeadLetters(path("dead"))
    ingest.ingest_customers(spark, first, log, 1, letters)
    ingest.ingest_customers_typed(spark, second, log, 2, letters)
    assert rows(log.current(spark)) == [("1", "a", "1"), ("2", "new", "9"), ("3", "c", "3")]


def test_columns_are_found_by_name(spark, path):
    target = write(path("c.csv"), 'amount,other,_id,name\n1,z,7,"a\nb"\n')
    got = files.read_csv_text(spark, target, SCHEMA, multi_line=True)
    assert rows(got) == [("7", "a\nb", "1", None)]
    typed = files.read_csv_typed(spark, target, table(name="string", amount="double"), multi_line=True)
    assert rows(typed) == [("a\nb", 1.0)]
    with pytest.raises(ValueError, match="missing"):
        files.read_csv_text(spark, write(path("d.csv"), "_id,name\n1,a\n"), SCHEMA)


def test_typed_load_sets_malformed_rows_aside(spark, path):
    log, letters = ChangeLog(path("bronze"), SCHEMA), DeadLetters(path("dead"))
    target = write(path("c.csv"), "_id,name,amount\n1,a,1\n,b,2\n3,c,3,4,5\n")
    ingest.ingest_customers_typed(spark, target, log, 1, letters)
    assert rows(log.current(spark)) == [("1", "a", "1")]
    assert sorted(r.reason for r in letters.read(spark).collect()) == ["damaged", "missing key"]


def test_missing_path_is_empty_but_other_errors_are_not(spark, path):
    assert files.read_parquet_or_empty(spark, path("none"), SCHEMA).isEmpty()
    write(path("bad"), "no parquet")
    with pytest.raises(Exception):
        files.read_parquet_or_empty(spark, path("bad"), SCHEMA).collect()


def test_schema_merge(spark, path):
    files.write_parquet(spark.sql("select 1 a"), path("p"))
    files.write_parquet(spark.sql("select 2 a, 'x' b"), path("p"))
    got = files.read_parquet_or_empty(spark, path("p"), SCHEMA, merge_schema=True)
    assert rows(got) == [(1, None), (2, "x")]
    assert not any("snappy" in f for f in os.listdir(path("p")))


def test_export(spark, path):
    files.write_parquet(spark.sql("select 1 a, 'q' b"), path("p"))
    files.parquet_to_csv(spark, path("p"), path("c"))
    assert rows(spark.read.csv(path("c"), header=True)) == [("1", "q")]
    with pytest.raises(AnalysisException):
        files.parquet_to_csv(spark, path("p"), path("c"))


def test_bi_table(spark, path):
    df = spark.sql("select 'a' _id, 3L score")
    files.write_parquet(df, path("p"))
    for _ in range(2):
        files.create_bi_table(spark, "reporting_scores", df.schema, path("p"))
    assert rows(spark.sql("SELECT * FROM reporting_scores LIMIT 10")) == [("a", 3)]
    spark.sql("DROP TABLE reporting_scores")


def test_relational_columns(spark):
    df = spark.sql("select 'a' _id, 2 amount, 'x' extra, 1 transaction_date")
    got, missing = files.matching_columns(df, ["Id", "AMOUNT", "TransactionDate", "branch"])
    assert got.columns == ["Id", "AMOUNT", "TransactionDate"] and missing == ["branch"]


def test_rows_survive_the_json_columns(spark):
    from ledgerlake.operators.decode import decode_json, encode_json, split_decoded

    schema = table(_id="string", v="double")
    df = spark.createDataFrame([("a", 1.5), ("b", None), (None, 2.0)], schema)
    kept = df.select(encode_json("_id", "v", keep_nulls=True).alias("value"))
    assert sorted(r.value for r in kept.collect())[1] == '{"_id":"b","v":null}'
    broken = kept.unionByName(spark.sql("""select '{"_id":"c","v":' as value union all
        select 'oops' union all select '{"_id":"d","v":"text"}' union all select cast(null as string)"""))
    good, bad = split_decoded(decode_json(broken, schema), "here")
    assert rows(good) == [("a", 1.5), ("b", None)]
    assert sorted(r.reason for r in bad.collect()) == ["damaged"] * 3 + ["missing key"] * 2
    assert good.count() + bad.count() == broken.count()
    assert bad.where(F.col("source") != "here").isEmpty()
