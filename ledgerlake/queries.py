"""Registered queries: each runs operators of the library over the whole test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas
from .functions import scalar
from .operators.decode import decode_json, split_decoded
from .operators.dedup import keep_latest
from .operators.fuzzy import add_subdivision, match_subdivisions
from .operators.lookup import account_owners, add_country, resolve_customers
from .operators.merge import merge
from .operators.scoring import flag_fraud, fraud_counts, pandas_scorer
from .plans import adapters, gold, ingest, monitor, silver, summary
from .plans.adapters import load
from .plans.profiles import latest_profiles
from .registry import query
from .schemas import table
from .session import materialize, scratch_path
from .sources import documents, files
from .sources.tables import RAW, ChangeLog, DeadLetters, VersionedTable
from .sources.topics import Topic, as_messages
from .streaming.changes import detect_on_change
from .streaming.flow import files_to_topic, topic_to_tables
from .streaming.ingest import ingest_transactions

# --- silver ------------------------------------------------------------------------


def _silver_customers(spark: SparkSession, sf: str, with_subdivision: bool = True) -> DataFrame:
    return silver.refine_customers(
        adapters.customers(spark, sf),
        adapters.countries(spark, sf),
        adapters.subdivisions(spark, sf),
        with_subdivision=with_subdivision,
    )


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return latest_profiles(
        adapters.transactions(spark, sf, with_seq=True),
        account_owners(adapters.customers(spark, sf)),
    )


def _silver_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return silver.refine_transactions(adapters.transactions(spark, sf))


@query
def customers_silver(spark, sf):
    return _silver_customers(spark, sf)


@query
def transactions_silver(spark, sf):
    return _silver_transactions(spark, sf)


@query
def category_mod10(spark, sf):
    return silver.refine_transactions(adapters.transactions(spark, sf), 10).select("_id", "category")


@query
def profile_latest(spark, sf):
    return _profiles(spark, sf).select("_id", "score")


@query
def receiver_lookup(spark, sf):
    owners = materialize(account_owners(adapters.customers(spark, sf)), "account-owners")
    found = resolve_customers(adapters.transactions(spark, sf), owners, "receiver_account")
    return found.select("_id", "receiver_account", "customer_id")


@query
def country_lookup(spark, sf):
    return add_country(adapters.customers(spark, sf), adapters.countries(spark, sf)).select(
        "_id", "country_code", "country"
    )


@query
def county_fuzzy(spark, sf):
    customers = adapters.customers(spark, sf).select("_id", "county")
    matches = match_subdivisions(customers.select("county"), adapters.subdivisions(spark, sf))
    return add_subdivision(customers, materialize(matches, "county-matches"))


@query
def part_name_contained(spark, sf):
    """Exact and contained hits only: every word of a part's name, sought in part names."""
    parts = load(spark, sf, "part")
    wanted = parts.select(F.explode(F.split("p_name", " ")).alias("county"))
    names = parts.groupBy(F.col("p_name").alias("name")).agg(
        F.min(scalar.padded("p_partkey", 12)).alias("code")
    )
    return match_subdivisions(wanted, names, max_distance=0)


@query
def mask_account(spark, sf):
    customers = adapters.customers(spark, sf)
    return customers.select(
        "_id",
        scalar.mask_tail("account_number", 8).alias("account_number"),
        scalar.mask_tail("_id", 3).alias("short_text"),
        scalar.masked(8).alias("birthdate"),
        scalar.masked(4).alias("current_location"),
    )


@query
def blank_accounts(spark, sf):
    return silver.blank_accounts(_silver_transactions(spark, sf))


# --- gold --------------------------------------------------------------------------


def _gold_customers(spark, sf, with_subdivision=True):
    return gold.gold_customers(_silver_customers(spark, sf, with_subdivision), _profiles(spark, sf))


def _gold_transactions(spark, sf):
    return gold.gold_transactions(_silver_transactions(spark, sf))


def _possible_fraud(spark, sf):
    return gold.possible_fraud(adapters.transactions(spark, sf))


def _gold_after_fraud(spark, sf):
    return merge(_gold_transactions(spark, sf), _possible_fraud(spark, sf))


@query
def gold_customers(spark, sf):
    return _gold_customers(spark, sf)


@query
def gold_transactions(spark, sf):
    return _gold_transactions(spark, sf)


@query
def fraud_flagged(spark, sf):
    return _possible_fraud(spark, sf)


@query
def fraud_count(spark, sf):
    return fraud_counts(flag_fraud(adapters.transactions(spark, sf), gold.FRAUD_SCORER))


@query
def pandas_scored(spark, sf):
    """The model hook with a vectorised Python model in place of the built-in hash."""
    scorer = pandas_scorer(lambda rows: rows["amount"] // 1000 % 101, ["amount"])
    return scorer(adapters.transactions(spark, sf)).select("_id", "score")


@query
def pandas_scored_nulls(spark, sf):
    """Transactions to receivers outside the bank have no amount, and so no score."""
    rows = adapters.transactions(spark, sf)
    inside = ~F.col("receiver_account").startswith("EXT")
    scorer = pandas_scorer(lambda batch: batch["amount"] // 1000 % 101, ["amount"])
    flagged = flag_fraud(rows.withColumn("amount", F.when(inside, F.col("amount"))), scorer)
    return flagged.select("_id", "score", "fraud")


@query
def customers_renamed_id(spark, sf):
    """A source that calls its key ``id``."""
    renamed = adapters.customers(spark, sf).withColumnRenamed("_id", "id")
    return silver.refine_customers(
        renamed, adapters.countries(spark, sf), adapters.subdivisions(spark, sf)
    )


@query
def country_doubled_names(spark, sf):
    """A dimension with two names for each code: a customer still has one row."""
    countries = adapters.countries(spark, sf)
    doubled = countries.unionByName(countries.withColumn("country", F.concat("country", F.lit(" (old)"))))
    return add_country(adapters.customers(spark, sf), doubled).select("_id", "country_code", "country")


@query
def gold_after_fraud(spark, sf):
    return _gold_after_fraud(spark, sf)


@query
def gold_preserve_flags(spark, sf):
    return merge(
        _gold_after_fraud(spark, sf), _gold_transactions(spark, sf), flags_to_keep=("fraud",)
    )


@query
def gold_flags_reset(spark, sf):
    return merge(_gold_after_fraud(spark, sf), _gold_transactions(spark, sf))


@query
def fraud_before_gold(spark, sf):
    """Detection before consolidation: flagged rows are inserted without a category."""
    return merge(
        spark.createDataFrame([], schemas.GOLD_TRANSACTIONS), _possible_fraud(spark, sf)
    )


@query
def fraud_view(spark, sf):
    return gold.fraud_view(_gold_after_fraud(spark, sf))


@query
def summary_category(spark, sf):
    return summary.by_category(_gold_after_fraud(spark, sf))


@query
def summary_rollup(spark, sf):
    return summary.by_category_and_month(_gold_after_fraud(spark, sf))


@query
def summary_country(spark, sf):
    return summary.by_country(_gold_customers(spark, sf, with_subdivision=False))


# --- keyed tables ------------------------------------------------------------------


@query
def dedup_keep_last(spark, sf):
    return keep_latest(load(spark, sf, "events"), "user_id", "event_id")


@query
def dedup_lineitem(spark, sf):
    return keep_latest(
        load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], adapters.LINE_ORDER
    )


@query
def upsert_replace(spark, sf):
    return merge(*adapters.line_documents(spark, sf), mode="replace")


@query
def merge_update(spark, sf):
    return merge(*adapters.line_documents(spark, sf), mode="update")


@query
def merge_patch_nulls(spark, sf):
    return merge(*adapters.line_documents(spark, sf), mode="patch")


@query
def wide_column_puts(spark, sf):
    """Null-skipping puts read back: the latest non-null cell of each column."""
    target, source = adapters.line_documents(spark, sf)
    schema = table(_id="string", part="long", quantity="double", status="string", tax="double")
    log = ChangeLog(scratch_path(spark, "cells"), schema)
    log.write_batch(target.withColumn("tax", F.lit(None)), 1)
    log.write_batch(source.withColumn("status", F.lit(None)), 2)
    return log.current_patched(spark)


@query
def reload_idempotent(spark, sf):
    """The same load twice: the current view holds each row once."""
    log = ChangeLog(scratch_path(spark, "bronze-transactions"), schemas.TRANSACTIONS)
    rows = adapters.transactions(spark, sf, with_seq=True)
    for batch_id in (1, 2):
        log.write_batch(rows, batch_id, seq=F.col("_seq"))
    return log.current(spark)


@query
def late_profiles(spark, sf):
    """Profiles of two sets of transactions merged in either order: the newer one stays."""
    owners = account_owners(adapters.customers(spark, sf))
    rows = adapters.transactions(spark, sf, with_seq=True)
    big = F.col("amount") > 200_000
    first, second = (latest_profiles(rows.where(part), owners) for part in (big, ~big))
    return merge(first, second, mode="replace", newest_by="_seq").select("_id", "score")


@query
def customer_reload(spark, sf):
    """All customers, then a second file in which those in debt have another company."""
    log = ChangeLog(scratch_path(spark, "bronze-customers"), schemas.CUSTOMERS)
    dead = DeadLetters(scratch_path(spark, "dead"))
    raw = adapters.customers(spark, sf)
    debtors = load(spark, sf, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").cast("string").alias("_id")
    )
    loads = (raw, raw.join(debtors, "_id", "left_semi").withColumn("company", F.lit("COLLECTION")))
    for batch_id, rows in enumerate(loads):
        csv = scratch_path(spark, "customers-csv")
        files.write_csv(_shuffled(rows), csv)
        ingest.ingest_customers(spark, csv, log, batch_id, dead, multi_line=True)
    return log.current(spark).select("_id", "company", "account_number")


def _shuffled(rows: DataFrame) -> DataFrame:
    """Customer columns in another order than the schema's, with one more."""
    return rows.select(*sorted(schemas.CUSTOMERS.names), F.lit("x").alias("extra"))


def _customer_file(spark, sf) -> DataFrame:
    """Customers through a file with shuffled columns and line breaks in addresses."""
    csv = scratch_path(spark, "customers-csv")
    files.write_csv(_shuffled(adapters.customers(spark, sf)), csv)
    return files.read_csv_text(spark, csv, schemas.CUSTOMERS, multi_line=True)


@query
def csv_reordered_columns(spark, sf):
    return _customer_file(spark, sf).drop(files.DAMAGED, "address")


@query
def csv_line_breaks(spark, sf):
    return _customer_file(spark, sf).select("_id", "address")


@query
def load_rejects(spark, sf):
    """Customers without an id in the file: what was landed and what was set aside, and why."""
    csv = scratch_path(spark, "customers-csv")
    rows = adapters.customers(spark, sf)
    known = F.col("_id").cast("bigint") % 7 != 0
    files.write_csv(_shuffled(rows.withColumn("_id", F.when(known, F.col("_id")))), csv)
    log = ChangeLog(scratch_path(spark, "bronze-customers"), schemas.CUSTOMERS)
    dead = DeadLetters(scratch_path(spark, "dead"))
    ingest.ingest_customers(spark, csv, log, 1, dead, multi_line=True)
    landed = log.current(spark).select(F.lit("landed").alias("outcome"))
    rejected = dead.read(spark).select(F.col("reason").alias("outcome"))
    return landed.unionByName(rejected).groupBy("outcome").agg(F.count("*").alias("rows"))


@query
def replayed_batches(spark, sf):
    """Each batch written twice, the second time in reverse: nothing changes."""
    log = ChangeLog(
        scratch_path(spark, "lines"),
        table(_id="string", part="long", quantity="double"),
    )
    batches = dict(enumerate(adapters.line_documents(spark, sf), 1))
    for batch_id in (1, 2, 2, 1):
        log.write_batch(batches[batch_id], batch_id)
    return log.current(spark)


@query
def upsert_repeated_keys(spark, sf):
    """All line items in one upsert keyed by order: the latest line of each stays."""
    lines = VersionedTable(scratch_path(spark, "lines"))
    source = load(spark, sf, "lineitem").withColumn("_id", F.col("l_orderkey").cast("string"))
    for _ in range(2):
        lines.upsert(source, mode="replace", order=adapters.LINE_ORDER)
    return lines.read(spark).select("_id", "l_linenumber", "l_shipdate", "l_quantity")


@query
def table_history(spark, sf):
    """Events loaded as one batch per day, then the list of batches."""
    events = load(spark, sf, "events")
    log = ChangeLog(
        scratch_path(spark, "event-log"),
        table(event_id="long", user_id="long", event_type="string", value="double"),
        key="event_id",
    )
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    log.write_batches(events, day, F.col("event_id"), F.col("ts"))
    return log.history(spark)


@query
def schema_evolution(spark, sf):
    """Rows written before a column existed are read with nulls in it."""
    path = scratch_path(spark, "evolving")
    rows = load(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
    )
    old = F.col("o_orderstatus") == "F"
    files.write_parquet(rows.where(old).drop("o_orderpriority"), path)
    files.write_parquet(rows.where(~old), path)
    return files.read_parquet_or_empty(spark, path, rows.schema, merge_schema=True)


# --- messages and text -------------------------------------------------------------


@query
def json_decode(spark, sf):
    decoded = decode_json(
        load(spark, sf, "events"), table(k="long"), value="props"
    )
    return decoded.select("event_id", "record.k")


@query
def json_dead_letter(spark, sf):
    """Messages of error events lose their last character and cannot be decoded."""
    cut = F.when(
        F.col("event_type") == "error", F.left("props", F.length("props") - 1)
    ).otherwise(F.col("props"))
    messages = load(spark, sf, "events").select(cut.alias("value"))
    decoded = decode_json(messages, table(k="long"))
    return split_decoded(decoded, "events", key="k")[1]


@query
def csv_decode(spark, sf):
    """Customers as lines in the dropped files' dialect, and back."""
    customers = adapters.customers(spark, sf).withColumn("address", scalar.one_line("address"))
    lines = customers.select(files.csv_row(*customers.columns).alias("line"))
    return lines.select(files.parse_csv_row("line", schemas.CUSTOMERS).alias("c")).select("c.*")


@query
def csv_file_scan(spark, sf):
    """Whole documents through a CSV file with header: every value comes back as text."""
    path = scratch_path(spark, "documents-csv")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    files.write_csv(docs, path)
    return files.read_csv_text(spark, path, docs.schema, multi_line=True).drop(files.DAMAGED)


@query
def csv_typed_scan(spark, sf):
    path = scratch_path(spark, "parts-csv")
    files.write_csv(load(spark, sf, "part"), path)
    scanned = files.read_csv_typed(spark, path)
    return scanned.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        "p_name", "p_brand", "p_type",
        F.col("p_size").cast("int").alias("p_size"),
        "p_retailprice",
    )


@query
def parquet_export(spark, sf):
    """Parquet directory to CSV export, read back."""
    stored, exported = scratch_path(spark, "suppliers"), scratch_path(spark, "suppliers-csv")
    suppliers = load(spark, sf, "supplier")
    files.write_parquet(suppliers, stored)
    files.parquet_to_csv(spark, stored, exported)
    return files.read_csv_typed(spark, exported, suppliers.schema)


@query
def bi_table(spark, sf):
    """An external table over the committed version of the gold transactions."""
    gold_table = VersionedTable(scratch_path(spark, "gold-transactions"))
    gold_table.upsert(_gold_transactions(spark, sf))
    gold_table.upsert(_possible_fraud(spark, sf))
    name = f"gold_transactions_{uuid.uuid4().hex}"
    files.create_bi_table(spark, name, gold_table.read(spark).schema, gold_table.location(spark))
    return spark.sql(f"SELECT _id, amount, category, transaction_date, fraud FROM {name}")


@query
def bi_table_preview(spark, sf):
    """The first rows of a reporting table in a database made on demand."""
    stored = VersionedTable(scratch_path(spark, "gold-transactions"), schemas.GOLD_TRANSACTIONS)
    stored.upsert(_gold_transactions(spark, sf))
    name = f"reports.gold_transactions_{uuid.uuid4().hex}"
    files.create_bi_table(spark, name, stored.read(spark).schema, stored.location(spark))
    return files.preview_table(spark, name, "_id")


@query
def relational_columns(spark, sf):
    """Rows cut to the columns a relational table has; names match loosely."""
    wanted = ["ID", "Amount", "TransactionDate", "Branch"]
    return files.matching_columns(_silver_transactions(spark, sf), wanted)[0]


@query
def clean_text(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", scalar.one_line("text").alias("text")
    )


@query
def iso_ampm(spark, sf):
    shown = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'hh:mm:ss.SSS"), F.lit("+0000 "), F.date_format("ts", "a")
    )
    return load(spark, sf, "events").select(
        "event_id", F.unix_millis(scalar.parse_iso_ampm(shown)).alias("millis")
    )


@query
def epoch_format(spark, sf):
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    millis = F.timestamp_diff("MILLISECOND", start, F.col("ts"))
    return load(spark, sf, "events").select(
        "event_id",
        scalar.format_millis(millis).alias("moment"),
        scalar.format_clock(millis).alias("clock"),
    )


@query
def round_amounts(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalar.round_amount(F.col("l_extendedprice") * 4 / 100).alias("fee"),
    )


# --- reads of a table --------------------------------------------------------------


@query
def find_by_field(spark, sf):
    return documents.find_by_field(adapters.customers(spark, sf), "company", "BUILDING")


@query
def find_by_id(spark, sf):
    found = documents.find_by_key(load(spark, sf, "orders"), "o_orderkey", 42)
    return adapters.transactions(spark, sf, orders=found)


@query
def search_select_where(spark, sf):
    where = {
        "$or": [
            {"$and": [{"$gt": {"amount": 250000.0}}, {"$like": {"receiver_account": "EXT%"}}]},
            {"$not": {"$ge": {"amount": 2000.0}}},
        ]
    }
    return documents.search(adapters.transactions(spark, sf), ["_id", "amount"], where)


@query
def peek_15(spark, sf):
    return documents.peek(adapters.customers(spark, sf), "_id").select("_id", "name", "county")


@query
def tail_100(spark, sf):
    return documents.tail(adapters.transactions(spark, sf, with_seq=True), "_seq").drop("_seq")


@query
def tail_with_total(spark, sf):
    rows = adapters.transactions(spark, sf, with_seq=True)
    return documents.tail_with_total(rows, "_seq").select("_id", "total")


# --- metrics -----------------------------------------------------------------------


def _tier_counts(spark, sf):
    """Each tier is counted from its own plan; nothing is written, and joins carry only keys."""
    customers = _silver_customers(spark, sf, with_subdivision=False)
    profiles = _profiles(spark, sf)
    transactions = _silver_transactions(spark, sf)
    gold_customers = gold.gold_customers(customers, profiles)
    after_fraud = merge(gold.gold_transactions(transactions), _possible_fraud(spark, sf))
    bronze_and_silver = monitor.tier_counts(
        {
            ("bronze", "transactions"): adapters.transactions(spark, sf),
            ("bronze", "customers"): adapters.customers(spark, sf),
            ("silver", "profiles"): profiles,
            ("silver", "transactions"): transactions,
            ("silver", "customers"): customers,
        }
    )
    return bronze_and_silver.unionByName(
        monitor.gold_counts(gold_customers, after_fraud)
    )


@query
def tier_counts(spark, sf):
    return _tier_counts(spark, sf)


@query
def topic_progress(spark, sf):
    return monitor.topic_progress(adapters.cursors(spark, sf))


@query
def consumer_lag(spark, sf):
    return monitor.consumer_lag(adapters.cursors(spark, sf))


@query
def lag_series(spark, sf):
    return monitor.as_series(monitor.consumer_lag(adapters.cursors(spark, sf)))


@query
def metrics_row(spark, sf):
    return monitor.snapshot(
        _tier_counts(spark, sf), monitor.topic_progress(adapters.cursors(spark, sf))
    )


@query
def flattened_series(spark, sf):
    """Each event as a map of series to value, flattened and cut to whole numbers."""
    events = load(spark, sf, "events").select(F.create_map("event_type", "value").alias("values"))
    return monitor.flatten_series(events, prefix="events")


@query
def metric_stream_filter(spark, sf):
    record = F.struct(
        F.concat(F.lit("app."), "event_type").alias("metric"),
        F.col("value"),
        F.struct(F.concat(F.lit("cluster"), (F.col("user_id") % 3).cast("string")).alias("clustername")).alias("tags"),
    )
    messages = load(spark, sf, "events").select(
        F.to_json(F.array(record)).alias("value"), F.col("ts").alias("timestamp")
    )
    watched = ["app.view", "app.click", "app.purchase", "app.signup"]
    return monitor.watched_metrics(messages, watched)


# --- streams -----------------------------------------------------------------------


def _partitions(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, 3)


def _third(spark) -> int:
    """Files per micro-batch, for runs of several batches."""
    return -(-_partitions(spark) // 3)


def _topic(spark, sf, damaged: bool = False) -> Topic:
    """All transactions as a topic of even files, taken in several batches of a file per core.

    With ``damaged`` the messages about receivers outside the bank lose their last character.
    """
    rows = adapters.transactions(spark, sf, with_seq=True)
    messages = as_messages(rows, F.col("_seq"), partitions=_partitions(spark))
    if damaged:
        text = F.col("value").cast("string")
        cut = F.when(text.contains("EXT"), F.left(text, F.length(text) - 1)).otherwise(text)
        messages = messages.withColumn("value", F.encode(cut, "UTF-8"))
    topic = Topic(scratch_path(spark, "topic"), name="transactions", per_trigger=_partitions(spark))
    # Dealt by offset: the few partitions would meet in fewer files, whose tasks hold several of them.
    topic.publish(messages.repartition(3 * _partitions(spark), "offset"))
    return topic


class _Ingested:
    """One run of the streaming ingest over a fresh topic."""

    def __init__(self, spark, sf, damaged: bool = False, topic: Topic | None = None):
        self.bronze = ChangeLog(scratch_path(spark, "bronze"), schemas.TRANSACTIONS, keep_raw=True)
        self.profiles = ChangeLog(scratch_path(spark, "profiles"), schemas.PROFILES)
        self.dead = DeadLetters(scratch_path(spark, "dead"))
        owners = VersionedTable(scratch_path(spark, "account-owners"))
        owners.publish(account_owners(adapters.customers(spark, sf)))
        ingest_transactions(
            spark, topic or _topic(spark, sf, damaged), self.bronze, self.profiles, self.dead,
            owners.read, scratch_path(spark, "checkpoint"),
        ).awaitTermination()


@query
def topic_round_trip(spark, sf):
    records = decode_json(_topic(spark, sf).read(spark), schemas.TRANSACTIONS)
    return records.select("record.*", "offset", F.col("key").cast("string").alias("message_key"))


@query
def stream_bronze(spark, sf):
    return _Ingested(spark, sf).bronze.current(spark)


@query
def stream_profiles(spark, sf):
    return _Ingested(spark, sf).profiles.current(spark)


@query
def stream_bronze_extra_fields(spark, sf):
    """Messages with a field that the bronze table does not know: it is read from the stored text."""
    rows = adapters.transactions(spark, sf, with_seq=True)
    rows = rows.withColumn("currency", F.when(F.col("amount") > 150_000, "USD").otherwise("GBP"))
    topic = Topic(scratch_path(spark, "topic"), name="transactions", per_trigger=_partitions(spark))
    topic.publish(as_messages(rows, F.col("_seq")))
    stored = _Ingested(spark, sf, topic=topic).bronze.rows(spark)
    return stored.select("_id", F.get_json_object(RAW, "$.currency").alias("currency"))


@query
def profiles_tied_times(spark, sf):
    """Many messages share a time and lie in four partitions: partition and offset decide."""
    rows = adapters.transactions(spark, sf, with_seq=True)
    second = (F.col("_seq") / 64).cast("bigint")
    messages = as_messages(rows, F.col("_seq")).join(
        rows.select(
            F.encode("_id", "utf-8").alias("key"),
            (F.col("_seq") % 4).cast("int").alias("place"), F.timestamp_seconds(second).alias("time"),
        ),
        "key",
    )
    topic = Topic(scratch_path(spark, "topic"), name="transactions", per_trigger=_partitions(spark), by_time=True)
    topic.publish(messages.withColumns({"partition": F.col("place"), "timestamp": F.col("time")}))
    return _Ingested(spark, sf, topic=topic).profiles.current(spark)


@query
def stream_dead_letter(spark, sf):
    run = _Ingested(spark, sf, damaged=True)
    kept = run.bronze.current(spark).select(F.lit("stored").alias("reason"))
    bad = run.dead.read(spark).select("reason")
    return kept.unionByName(bad).groupBy("reason").agg(F.count("*").alias("messages"))


def _flow(spark, sf):
    cells = table(**dict.fromkeys(schemas.TRANSACTIONS.names, "string"))
    bronze = ChangeLog(scratch_path(spark, "flow-bronze"), cells)
    silver_log = ChangeLog(
        scratch_path(spark, "flow-silver"), StructType(list(cells.fields)).add("category", "string")
    )
    relational = scratch_path(spark, "flow-relational")

    def insert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{relational}/batch={batch_id}")

    topic_to_tables(
        spark, _topic(spark, sf), bronze, silver_log, insert,
        DeadLetters(scratch_path(spark, "flow-dead")), scratch_path(spark, "checkpoint"),
    ).awaitTermination()
    return bronze, silver_log, relational


def _numbers(cells: DataFrame) -> DataFrame:
    return cells.withColumns(
        {c: F.col(c).cast("double") for c in ("amount", "transaction_date")}
    )


@query
def stream_flow_bronze(spark, sf):
    return _numbers(_flow(spark, sf)[0].current_patched(spark))


@query
def stream_flow_silver(spark, sf):
    return _numbers(_flow(spark, sf)[1].current_patched(spark))


@query
def stream_flow_relational(spark, sf):
    return _numbers(spark.read.parquet(_flow(spark, sf)[2]).drop("batch"))


class _Dropped:
    """Transactions dropped as CSV files and sent to a topic."""

    def __init__(self, spark, rows: DataFrame):
        dropped, self.audit_path = scratch_path(spark, "dropped"), scratch_path(spark, "audit")
        shuffled = rows.select(*sorted(rows.columns), F.lit("x").alias("extra"))
        shuffled.repartition(_partitions(spark)).write.options(**files.CSV_DIALECT).csv(dropped)
        self.topic = Topic(scratch_path(spark, "topic"), name="transactions")
        self.dead = DeadLetters(scratch_path(spark, "dead"))
        files_to_topic(
            spark, dropped, self.topic, F.col("_id").cast("bigint"), self.dead,
            scratch_path(spark, "checkpoint"), file_pattern="part-*",
            audit_path=self.audit_path, files_per_poll=_third(spark),
        ).awaitTermination()


@query
def file_to_topic(spark, sf):
    topic = _Dropped(spark, adapters.transactions(spark, sf)).topic
    return decode_json(topic.read(spark), schemas.TRANSACTIONS).select("record.*")


@query
def file_to_topic_rejects(spark, sf):
    """Rows for receivers outside the bank have lost their id: what is logged, what is rejected."""
    rows = adapters.transactions(spark, sf)
    outside = F.col("receiver_account").startswith("EXT")
    run = _Dropped(spark, rows.withColumn("_id", F.when(~outside, F.col("_id"))))
    logged = spark.read.schema(schemas.TRANSACTIONS).json(run.audit_path)
    return (
        logged.select(F.lit("logged").alias("outcome"), "receiver_account")
        .unionByName(
            run.dead.read(spark).select(
                F.col("reason").alias("outcome"), F.split("raw", ",")[2].alias("receiver_account")
            )
        )
    )


@query
def file_to_topic_bad_values(spark, sf):
    """Amounts that are no numbers: what is logged, what is rejected; none is sent as null."""
    rows = adapters.transactions(spark, sf)
    outside = F.col("receiver_account").startswith("EXT")
    run = _Dropped(spark, rows.withColumn("amount", F.when(outside, "abc").otherwise(F.col("amount").cast("string"))))
    sent = decode_json(run.topic.read(spark), schemas.TRANSACTIONS).select("record.*")
    return (
        sent.select(F.lit("sent").alias("outcome"), F.col("amount").isNull().alias("no_amount"))
        .unionByName(run.dead.read(spark).select(F.col("reason").alias("outcome"), F.lit(True).alias("no_amount")))
        .groupBy("outcome", "no_amount").agg(F.count("*").alias("rows"))
    )


@query
def cdc_fraud(spark, sf):
    """Bronze filled in two loads, followed by detection on the changes."""
    bronze = ChangeLog(scratch_path(spark, "bronze"), schemas.TRANSACTIONS)
    flagged_schema = table(_id="string", amount="double", transaction_date="double", fraud="boolean")
    fraud = ChangeLog(scratch_path(spark, "fraud"), flagged_schema)
    checkpoint = scratch_path(spark, "checkpoint")
    rows = adapters.transactions(spark, sf, with_seq=True)
    late = F.col("receiver_account").startswith("EXT")
    for batch_id, part in enumerate((rows.where(~late), rows.where(late))):
        bronze.write_batch(part, batch_id, seq=F.col("_seq"))
        detect_on_change(spark, bronze, fraud, checkpoint).awaitTermination()
    return fraud.current(spark)


# --- the whole run -----------------------------------------------------------------


def _medallion(spark, sf) -> tuple[VersionedTable, VersionedTable]:
    """Customer file and transaction topic through all tiers, table by table."""
    csv = scratch_path(spark, "customers-csv")
    files.write_csv(_shuffled(adapters.customers(spark, sf)), csv)
    dead = DeadLetters(scratch_path(spark, "dead-customers"))
    bronze_customers = ChangeLog(scratch_path(spark, "bronze-customers"), schemas.CUSTOMERS)
    for batch_id in (1, 2):
        ingest.ingest_customers(spark, csv, bronze_customers, batch_id, dead, multi_line=True)

    owners = VersionedTable(scratch_path(spark, "account-owners"))
    owners.publish(account_owners(bronze_customers.current(spark)))

    bronze = ChangeLog(scratch_path(spark, "bronze"), schemas.TRANSACTIONS, keep_raw=True)
    profiles = ChangeLog(scratch_path(spark, "profiles"), schemas.PROFILES)
    ingest_transactions(
        spark, _topic(spark, sf), bronze, profiles, DeadLetters(scratch_path(spark, "dead")),
        owners.read, scratch_path(spark, "checkpoint"),
    ).awaitTermination()

    buckets = _partitions(spark)
    silver_customers = VersionedTable(scratch_path(spark, "silver-customers"), buckets=buckets)
    silver_customers.upsert(
        silver.refine_customers(
            bronze_customers.current(spark),
            adapters.countries(spark, sf),
            adapters.subdivisions(spark, sf),
            counties=bronze_customers.rows(spark),
        ),
        mode="replace",
    )
    silver_transactions = VersionedTable(scratch_path(spark, "silver-transactions"), buckets=buckets)
    silver_transactions.upsert(silver.refine_transactions(bronze.current(spark)), mode="replace")

    customers_table = VersionedTable(scratch_path(spark, "gold-customers"), buckets=buckets)
    transactions_table = VersionedTable(scratch_path(spark, "gold-transactions"), buckets=buckets)
    gold.consolidate(
        spark, silver_customers, profiles, silver_transactions, customers_table, transactions_table
    )
    # silver holds the deduplicated bronze rows, so detection need not deduplicate them again
    gold.detect_fraud(spark, silver_transactions, transactions_table)
    return customers_table, transactions_table


@query
def medallion_customers(spark, sf):
    return _medallion(spark, sf)[0].read(spark)


@query
def medallion_transactions(spark, sf):
    return _medallion(spark, sf)[1].read(spark)


@query
def typed_customer_load(spark, sf):
    """The scheduled job: a CSV whose types are inferred, landed in bronze."""
    csv = scratch_path(spark, "customers-csv")
    columns = ["_id", "name", "mail", "account_number", "company", "county"]
    files.write_csv(adapters.customers(spark, sf).select(columns), csv)
    bronze = ChangeLog(
        scratch_path(spark, "bronze-customers"),
        table(**dict.fromkeys(columns, "string")),
    )
    ingest.ingest_customers_typed(spark, csv, bronze, 1, DeadLetters(scratch_path(spark, "dead")))
    return bronze.current(spark)
