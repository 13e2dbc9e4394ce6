"""Registered queries of change logs, merges, documents, models and trends."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators.merge import merge
from .operators.scoring import flag_fraud, model_scorer
from .oracle import _CATEGORIES, _GOLD_TRANSACTIONS, _TRANSACTIONS, _hash
from .plans import adapters, gold, silver, summary
from .plans.adapters import load
from .registry import SQL, query
from .schemas import table
from .session import materialize, scratch_path
from .sources import documents, files
from .sources.tables import ChangeLog

# --- change logs -------------------------------------------------------------------

#: A customer's company and account, as loads deliver them.
COMPANIES = table(_id="string", company="string", account="double")


def _company_log(spark: SparkSession, sf: str) -> ChangeLog:
    """All customers; then all again, those in debt with another company; then every fifth moved and the first load repeated."""
    log = ChangeLog(scratch_path(spark, "companies"), COMPANIES)
    rows = load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("_id"), F.col("c_mktsegment").alias("company"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("account"), "c_custkey", "c_acctbal",
    )
    debtors = F.when(F.col("c_acctbal") < 0, "COLLECTION").otherwise(F.col("company"))
    fifth = F.col("c_custkey") % 5 == 0
    log.write_batch(rows.where("c_custkey % 7 != 0"), 1)
    log.write_batch(rows.withColumn("company", debtors), 2)
    log.write_batch(rows.withColumn("company", debtors), 3)
    log.write_batch(rows.where(fifth).withColumn("account", F.lit(0.0)).withColumn("company", debtors), 4)
    return log


def _flat(changes: DataFrame) -> DataFrame:
    return changes.select(
        "_id", F.col("batch_id"), "kind", F.col("before.company").alias("company_before"),
        F.col("after.company").alias("company_after"), F.col("before.account").alias("account_before"),
        F.col("after.account").alias("account_after"),
    )


_COMPANY_LOG = """
loads AS (
    SELECT c_custkey AS k, c_mktsegment AS company, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS account,
        CASE WHEN c_acctbal < 0 THEN 'COLLECTION' ELSE c_mktsegment END AS moved FROM customer
), log AS (
    SELECT k, 1 AS batch_id, company, account FROM loads WHERE k % 7 <> 0
    UNION ALL SELECT k, 2, moved, account FROM loads
    UNION ALL SELECT k, 3, moved, account FROM loads
    UNION ALL SELECT k, 4, moved, 0.0 FROM loads WHERE k % 5 = 0
), compared AS (
    SELECT *, lag(batch_id) OVER w AS earlier, lag(company) OVER w AS company_before, lag(account) OVER w AS account_before
    FROM log WINDOW w AS (PARTITION BY k ORDER BY batch_id)
), changes AS (
    SELECT CAST(k AS VARCHAR) AS _id, CAST(batch_id AS BIGINT) AS batch_id,
        CASE WHEN earlier IS NULL THEN 'insert' ELSE 'update' END AS kind,
        company_before, company AS company_after, account_before, account AS account_after
    FROM compared WHERE earlier IS NULL OR company IS DISTINCT FROM company_before OR account IS DISTINCT FROM account_before
)"""


@query
def change_feed(spark, sf):
    """Every change of the log; the third load repeats the second and makes none."""
    return _flat(_company_log(spark, sf).changes(spark))


@query
def change_feed_since(spark, sf):
    """The changes of the last two loads, from these loads and the rows they touch."""
    return _flat(_company_log(spark, sf).changes(spark, since=2))


@query
def log_as_of(spark, sf):
    """The log's rows as they were after the second load."""
    return _company_log(spark, sf).view(spark, upto=2).select(*COMPANIES.names)


@query
def log_refreshed(spark, sf):
    """A view stored after the first load, brought up to date by the later loads."""
    log = _company_log(spark, sf)
    stored = materialize(log.view(spark, upto=1), "company-view")
    return log.refreshed(spark, stored, since=1).select(*COMPANIES.names)


SQL["change_feed"] = f"WITH {_COMPANY_LOG} SELECT * FROM changes"
SQL["change_feed_since"] = f"WITH {_COMPANY_LOG} SELECT * FROM changes WHERE batch_id > 2"
SQL["log_as_of"] = f"WITH {_COMPANY_LOG} SELECT CAST(k AS VARCHAR) AS _id, company, account FROM log WHERE batch_id = 2"
SQL["log_refreshed"] = f"""WITH {_COMPANY_LOG}
    SELECT CAST(k AS VARCHAR) AS _id, company, account FROM log QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch_id DESC) = 1"""


@query
def merge_repeated_keys(spark, sf):
    """Lines merged by order key, with many lines of an order on either side: the latest of each side counts."""
    lines = load(spark, sf, "lineitem").withColumn("_id", F.col("l_orderkey").cast("string"))
    returned = F.col("l_returnflag") == "R"
    chosen = [c for c in adapters.LINE_ORDER if c not in ("l_returnflag", "l_linestatus")]
    merged = merge(
        lines.where(~returned).select("_id", *adapters.LINE_ORDER),
        lines.where(returned).select("_id", *chosen),
        order=chosen, target_order=adapters.LINE_ORDER,
    )
    return merged.select("_id", "l_linenumber", "l_partkey", "l_quantity", "l_linestatus")


_ORDERED = "l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC"
SQL["merge_repeated_keys"] = f"""
WITH t AS (
    SELECT * FROM lineitem WHERE l_returnflag <> 'R'
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}, l_returnflag DESC, l_linestatus DESC) = 1
), s AS (
    SELECT * FROM lineitem WHERE l_returnflag = 'R'
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}) = 1
)
SELECT CAST(coalesce(t.l_orderkey, s.l_orderkey) AS VARCHAR) AS _id, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
    coalesce(s.l_partkey, t.l_partkey) AS l_partkey, coalesce(s.l_quantity, t.l_quantity) AS l_quantity, t.l_linestatus
FROM t FULL JOIN s ON t.l_orderkey = s.l_orderkey"""


# --- flags kept apart --------------------------------------------------------------


@query
def gold_flags_joined(spark, sf):
    """Consolidation on plain files, detection over two loads into a table of flags, joined when read."""
    bronze = ChangeLog(scratch_path(spark, "bronze"), schemas.TRANSACTIONS)
    flags = ChangeLog(scratch_path(spark, "flags"), table(_id="string", fraud="boolean"))
    silver_log = ChangeLog(scratch_path(spark, "silver"), schemas.SILVER_TRANSACTIONS)
    rows = adapters.transactions(spark, sf, with_seq=True)
    early = F.col("_seq") % 3 != 0
    for batch_id, part in enumerate((early, ~early)):
        bronze.write_batch(rows.where(part), batch_id, seq=F.col("_seq"))
        refined = silver.refine_transactions(rows.where(part).drop("_seq"))
        silver_log.write_batch(refined, batch_id)
        gold.log_fraud(spark, bronze, flags, batch_id, since=batch_id - 1)
    people = ChangeLog(scratch_path(spark, "silver-customers"), schemas.SILVER_CUSTOMERS)
    people.write_batch(
        silver.refine_customers(adapters.customers(spark, sf), adapters.countries(spark, sf), adapters.subdivisions(spark, sf)), 1
    )
    profiles = ChangeLog(scratch_path(spark, "profiles"), schemas.PROFILES)
    profiles.write_batch(spark.createDataFrame([("0", 1)], schemas.PROFILES), 1)
    stored = scratch_path(spark, "gold")
    gold.write_gold(spark, people, profiles, silver_log, stored)
    return gold.with_flags(spark.read.parquet(f"{stored}/transactions"), flags).select(*schemas.GOLD_TRANSACTION_COLUMNS)


SQL["gold_flags_joined"] = f"WITH {_GOLD_TRANSACTIONS} SELECT * FROM g_after"


# --- lookups and documents ---------------------------------------------------------


@query
def keyed_lookup(spark, sf):
    """Some ids and some that do not exist, looked up in a table written for lookups."""
    stored = scratch_path(spark, "transactions-by-id")
    files.write_keyed(adapters.transactions(spark, sf), stored, "_id")
    return documents.find_by_key(spark.read.parquet(stored), "_id", "7", "42", "1001", "none", "-1")


SQL["keyed_lookup"] = f"WITH {_TRANSACTIONS} SELECT * EXCLUDE (seq) FROM v_transactions WHERE _id IN ('7', '42', '1001', 'none', '-1')"


def _documents(spark, sf) -> DataFrame:
    """Events as JSON texts of a shape for each type; those of errors are cut short."""
    user = F.struct(F.col("user_id").alias("id"))
    shapes = {
        "purchase": F.struct("event_id", user.alias("user"), F.struct("value", F.lit("EUR").alias("unit")).alias("paid")),
        "signup": F.struct("event_id", F.struct(F.col("user_id").cast("string").alias("id")).alias("user")),
    }
    plain = F.to_json(F.struct("event_id", user.alias("user"), F.from_json("props", "k bigint").alias("props")))
    text = plain
    for kind, shape in shapes.items():
        text = F.when(F.col("event_type") == kind, F.to_json(shape)).otherwise(text)
    text = F.when(F.col("event_type") == "error", F.left(text, F.length(text) - 1)).otherwise(text)
    return load(spark, sf, "events").select("event_type", text.alias("value"))


def _stored_documents(spark, sf) -> tuple[DataFrame, DataFrame]:
    good, bad = documents.split_documents(_documents(spark, sf), "value")
    path = scratch_path(spark, "documents")
    good.write.parquet(path)
    return spark.read.parquet(path), bad


@query
def documents_by_path(spark, sf):
    """Documents of several shapes stored as they are, and read by path."""
    docs, _ = _stored_documents(spark, sf)
    return docs.select(
        documents.at("doc", "$.event_id", "bigint").alias("event_id"),
        documents.at("doc", "$.user.id", "bigint").alias("user_id"),
        documents.at("doc", "$.paid.value", "double").alias("paid"),
        documents.at("doc", "$.props.k", "int").alias("k"),
    )


@query
def document_fields(spark, sf):
    """How many documents there are, which fields they have, and how many texts are no documents."""
    docs, bad = _stored_documents(spark, sf)
    rejected = bad.agg(F.count("*").alias("rejected"))
    shape = F.regexp_replace("shape", r"DECIMAL\(\d+,\d+\)", "DECIMAL").alias("shape")
    return documents.fields(docs).select("documents", shape).crossJoin(rejected)  # one row each


SQL["documents_by_path"] = """
SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS paid,
    CASE WHEN event_type NOT IN ('purchase', 'signup') THEN CAST(props ->> 'k' AS INTEGER) END AS k
FROM events WHERE event_type <> 'error'"""
SQL["document_fields"] = """
SELECT count(*) FILTER (event_type <> 'error') AS documents, count(*) FILTER (event_type = 'error') AS rejected,
    'OBJECT<event_id: BIGINT, paid: OBJECT<unit: STRING, value: DECIMAL>, props: OBJECT<k: BIGINT>, user: OBJECT<id: VARIANT>>' AS shape
FROM events"""


# --- models ------------------------------------------------------------------------


def load_linear(data: bytes) -> dict:
    return json.loads(data)


def predict_linear(model: dict, batch: pd.DataFrame) -> pd.Series:
    return ((batch["amount"] * model["amount"] + model["base"]) // 1 % 101).astype("Float64")


@query
def model_scored(spark, sf):
    """A linear model kept in a file, loaded once in each task; a transaction without an amount has no score."""
    path = scratch_path(spark, "model")
    model = json.dumps({"amount": 0.001, "base": 3.0})
    spark.createDataFrame([(model,)], "value string").coalesce(1).write.text(path)
    inside = ~F.col("receiver_account").startswith("EXT")
    rows = adapters.transactions(spark, sf).withColumn("amount", F.when(inside, F.col("amount")))
    scorer = model_scorer(spark, f"{path}/*.txt", load_linear, predict_linear, ["amount"])
    return flag_fraud(rows, scorer).select("_id", "score", "fraud")


SQL["model_scored"] = f"""
WITH {_TRANSACTIONS}, scored AS (
    SELECT _id, CASE WHEN receiver_account NOT LIKE 'EXT%' THEN CAST(floor(amount * 0.001::DOUBLE + 3) % 101 AS BIGINT) END AS score
    FROM v_transactions
)
SELECT _id, score, coalesce(score > 85, false) AS fraud FROM scored"""


# --- trends ------------------------------------------------------------------------


def _gold_after_fraud(spark, sf) -> DataFrame:
    refined = silver.refine_transactions(adapters.transactions(spark, sf))
    return merge(gold.gold_transactions(refined), gold.possible_fraud(adapters.transactions(spark, sf)))


@query
def summary_trend(spark, sf):
    return summary.monthly_trend(_gold_after_fraud(spark, sf))


@query
def summary_cube(spark, sf):
    return summary.by_any_of(_gold_after_fraud(spark, sf))


@query
def summary_reach(spark, sf):
    """Receivers per category and month from daily sketches, beside the true number."""
    rows = silver.refine_transactions(adapters.transactions(spark, sf))
    sketches = materialize(summary.daily_sketches(rows, "receiver_account"), "daily-sketches")
    exact = summary.with_month(rows).groupBy("category", "month").agg(F.count_distinct("receiver_account").alias("receivers"))
    both = exact.join(summary.monthly_reach(sketches), ["category", "month"])
    near = F.abs(F.col("about") - F.col("receivers")) <= 1 + F.col("receivers") * 0.08
    return both.select("category", "month", "receivers", near.alias("near"))


_MONTHS = f"""{_GOLD_TRANSACTIONS}, dated AS (
    SELECT *, make_timestamp(CAST(transaction_date * 1000000 AS BIGINT)) AS day, CAST(round(amount * 100) AS BIGINT) AS c FROM g_after
)"""
SQL["summary_trend"] = f"""
WITH {_MONTHS}, months AS (
    SELECT category, year(day) * 12 + month(day) - 1 AS m, count(*) AS transactions, CAST(sum(c) AS BIGINT) AS cents,
        count(*) FILTER (fraud) AS fraud
    FROM dated GROUP BY ALL
)
SELECT category, strftime(make_date(CAST(m // 12 AS BIGINT), CAST(m % 12 + 1 AS BIGINT), 1), '%Y-%m') AS month, transactions, cents, fraud,
    CAST(cents - sum(cents) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS BIGINT) AS month_change,
    CAST(cents - sum(cents) OVER (w RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS BIGINT) AS year_change,
    CAST(sum(cents) OVER (w RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
        / count(*) OVER (w RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_3,
    CAST(sum(transactions) OVER (w RANGE UNBOUNDED PRECEDING) AS BIGINT) AS so_far
FROM months WINDOW w AS (PARTITION BY category ORDER BY m)"""
SQL["summary_cube"] = f"""
WITH {_MONTHS}
SELECT category, strftime(day, '%Y-%m') AS month, fraud,
    CAST(grouping_id(category, strftime(day, '%Y-%m'), fraud) AS INTEGER) AS level, count(*) AS transactions, CAST(sum(c) AS BIGINT) AS cents
FROM dated GROUP BY CUBE (category, strftime(day, '%Y-%m'), fraud)"""
SQL["summary_reach"] = f"""
WITH {_TRANSACTIONS}
SELECT {_CATEGORIES}[1 + {_hash('_id', 11)}] AS category,
    strftime(make_timestamp(CAST(transaction_date * 1000000 AS BIGINT)), '%Y-%m') AS month,
    count(DISTINCT receiver_account) AS receivers, true AS near
FROM v_transactions GROUP BY ALL"""
