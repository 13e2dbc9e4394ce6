"""Entities of the three tiers."""

from __future__ import annotations

from pyspark.sql.types import StructType

TIERS = ("bronze", "silver", "gold")

# Columns of the raw customer file, all text.
CUSTOMER_COLUMNS = (
    "_id", "name", "birthdate", "current_location", "mail", "username", "address",
    "account_number", "ssn", "blood_group", "company", "job", "sex", "county",
    "country_code",
)

# What a gold customer may carry. Everything else is personal.
GOLD_CUSTOMER_COLUMNS = (
    "_id", "blood_group", "company", "country", "country_code", "county",
    "iso3166_2", "job", "sex", "score",
)

# What a gold transaction may carry.
GOLD_TRANSACTION_COLUMNS = ("_id", "amount", "category", "transaction_date", "fraud")

# Account columns removed or blanked before sharing.
ACCOUNT_COLUMNS = ("sender_account", "receiver_account")

# Spending categories in the order they are numbered.
CATEGORIES = (
    "Entertainment", "Shopping", "Education", "Investment", "Bills", "Transport",
    "Income", "Home", "Transfers", "Dining", "Other",
)

# Names of the monitored counters.
METRICS = (
    "transactions_ingested", "transactions_processed", "bronze_customers",
    "bronze_transactions", "silver_profiles", "silver_transactions",
    "silver_customers", "gold_transactions", "gold_customers", "gold_fraud",
)


def table(**columns: str) -> StructType:
    """A schema from ``name="type"`` pairs; needs no running session."""
    schema = StructType()
    for name, kind in columns.items():
        schema.add(name, kind)
    return schema


CUSTOMERS = table(**dict.fromkeys(CUSTOMER_COLUMNS, "string"))
TRANSACTIONS = table(
    _id="string", sender_account="string", receiver_account="string",
    amount="double", transaction_date="double",
)
PROFILES = table(_id="string", score="long")
SILVER_CUSTOMERS = table(**dict.fromkeys((*CUSTOMER_COLUMNS, "country", "iso3166_2"), "string"))
SILVER_TRANSACTIONS = table(
    _id="string", sender_account="string", receiver_account="string",
    amount="double", transaction_date="double", category="string",
)
GOLD_CUSTOMERS = table(**{**dict.fromkeys(GOLD_CUSTOMER_COLUMNS, "string"), "score": "long"})
GOLD_TRANSACTIONS = table(
    _id="string", amount="double", category="string", transaction_date="double", fraud="boolean"
)
DEAD_LETTERS = table(reason="string", raw="string", source="string", batch_id="long")

#: A streaming query's report on one batch, as it gave it.
PROGRESS = table(query="string", run_id="string", batch_id="long", progress="string")

#: The order of a source: wide enough for a time, a partition and an offset in one number.
SEQ_TYPE = "decimal(38,0)"

# A topic record as the Kafka source delivers it.
TOPIC_RECORD = table(
    key="binary", value="binary", partition="integer", offset="long", timestamp="timestamp"
)
METRIC_RECORD = "array<struct<metric: string, value: double, tags: struct<clustername: string>>>"
