"""Silver to gold: consolidation, fraud detection, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import to_percentile
from ..operators.dedup import keep_latest
from ..operators.scoring import FRAUD_THRESHOLD, Scorer, flag_fraud, hash_scorer
from ..schemas import ACCOUNT_COLUMNS, GOLD_CUSTOMER_COLUMNS
from ..session import materialize
from ..sources.documents import query
from ..sources.tables import ORDER, ChangeLog, Table, VersionedTable, require_rows

FRAUD_SCORER = hash_scorer(salt="fraud:")


def gold_customers(customers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Customers with their score, without personal data.

    The score of a customer without a profile is 0; a score that is no number is null.
    An allow-list picks the columns, so a new personal column cannot slip through.
    """
    scores = profiles.select("_id", F.col("score").cast("string").alias("score"))
    return (
        customers.join(scores, "_id", "left")
        .fillna({"score": "0"})
        .withColumn("score", to_percentile("score"))
        .select(*GOLD_CUSTOMER_COLUMNS)
    )


def gold_transactions(transactions: DataFrame) -> DataFrame:
    """Transactions without accounts, not yet known to be fraud."""
    return transactions.drop(*ACCOUNT_COLUMNS).withColumn("fraud", F.lit(False))


def possible_fraud(
    transactions: DataFrame, scorer: Scorer = FRAUD_SCORER, threshold: int = FRAUD_THRESHOLD
) -> DataFrame:
    """Bronze transactions whose score is above the threshold, cleaned for gold."""
    return reported(flag_fraud(transactions, scorer, threshold))


def reported(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("fraud")).drop("score", *ACCOUNT_COLUMNS)


def consolidate(
    spark: SparkSession,
    customers: Table,
    profiles: Table,
    transactions: Table,
    customers_table: VersionedTable,
    transactions_table: VersionedTable,
    preserve_flags: bool = False,
) -> None:
    """Merge the silver tables into gold. Stops before any write if one is empty.

    Consolidation sets ``fraud`` to false again unless ``preserve_flags`` is given, so
    detection is run after it.
    """
    require_rows(spark, profiles, customers, transactions)
    scores = profiles.current(spark)
    clustered = customers_table.same_buckets(customers)
    if clustered:
        # The scores go to the customers' buckets, so only they are shuffled.
        scores = scores.repartition(customers_table.buckets, "_id")
    customers_table.upsert(gold_customers(customers.current(spark), scores), clustered=clustered)
    transactions_table.upsert(
        gold_transactions(transactions.current(spark)),
        clustered=transactions_table.same_buckets(transactions),
        flags_to_keep=("fraud",) if preserve_flags else (),
    )


def detect_fraud(
    spark: SparkSession,
    bronze: Table,
    transactions_table: VersionedTable,
    scorer: Scorer = FRAUD_SCORER,
    threshold: int = FRAUD_THRESHOLD,
) -> tuple[int, int]:
    """Flag transactions in gold with one merge; returns how many are fraud and valid.

    One pass scores each transaction once: it stores the flagged rows and counts all
    rows on the way, in the tasks that write.
    """
    require_rows(spark, bronze)
    counts = Observation("fraud detection")
    scored = flag_fraud(bronze.current(spark), scorer, threshold).observe(
        counts,
        F.count_if("fraud").alias("fraud"),
        F.count_if(~F.col("fraud")).alias("valid"),
    )
    transactions_table.upsert(materialize(reported(scored), "possible-fraud"))
    return counts.get["fraud"], counts.get["valid"]


def log_fraud(
    spark: SparkSession,
    bronze: ChangeLog,
    flags: ChangeLog,
    batch_id: int,
    since: int | None = None,
    scorer: Scorer = FRAUD_SCORER,
    threshold: int = FRAUD_THRESHOLD,
) -> None:
    """Write what detection finds in the batches after ``since`` as rows of their own, and nothing else.

    ``flags`` has a row per scored transaction whose flag is set, or was set and is no longer;
    gold stays as it is, so a run costs what the new batches cost.
    """
    rows = bronze.rows(spark)
    rows = rows if since is None else rows.where(F.col("batch_id") > since)
    latest = keep_latest(rows, bronze.key, ORDER)
    flagged = flag_fraud(latest, scorer, threshold).select("_id", "fraud", "_seq")
    known = flags.view(spark).select("_id", F.col("fraud").alias("was"))
    changed = flagged.join(known, "_id", "left").where(F.col("fraud") != F.coalesce("was", F.lit(False)))
    # stored first: the log that is written is also read here
    flags.write_batch(materialize(changed, "changed-flags"), batch_id, seq=F.col("_seq"))


def with_flags(transactions: DataFrame, flags: ChangeLog) -> DataFrame:
    """Gold transactions with the flags that detection has logged, joined when they are read."""
    known = flags.view(transactions.sparkSession).select("_id", F.col("fraud").alias("_flag"))
    flag = F.coalesce("_flag", F.lit(False)).alias("fraud")
    rest = [c for c in transactions.columns if c != "fraud"]
    return transactions.join(known, "_id", "left").select(*rest, flag)


def write_gold(spark: SparkSession, customers: ChangeLog, profiles: ChangeLog, transactions: ChangeLog, path: str) -> None:
    """Consolidate silver into plain Parquet under ``path``, without flags. Stops before any write if a table is empty."""
    require_rows(spark, profiles, customers, transactions)
    people = gold_customers(customers.current(spark), profiles.current(spark))
    people.write.mode("overwrite").parquet(f"{path}/customers")
    gold_transactions(transactions.current(spark)).write.mode("overwrite").parquet(f"{path}/transactions")


def fraud_view(gold: DataFrame) -> DataFrame:
    return query(gold, "fraud = true")
