"""Customer profiles: the score of the last transaction each customer received."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import keep_latest
from ..operators.lookup import resolve_customers
from ..operators.scoring import Scorer, hash_scorer

# The profile score is drawn apart from the one used for fraud detection.
PROFILE_SCORER = hash_scorer(salt="profile:")


def latest_profiles(
    transactions: DataFrame,
    owners: DataFrame,
    scorer: Scorer = PROFILE_SCORER,
    seq: str = "_seq",
) -> DataFrame:
    """``_id, score, _seq`` per customer, in the order given by ``seq``.

    ``owners`` is the account directory of ``account_owners``.
    Transactions are reduced to one per account before the join, so a busy account
    reaches it as one row, and only transactions that set a profile are scored.
    """
    per_account = keep_latest(transactions, "receiver_account", seq)
    owned = resolve_customers(per_account, owners, "receiver_account")
    per_customer = keep_latest(owned, "customer_id", seq)
    return scorer(per_customer).select(
        F.col("customer_id").alias("_id"), F.col("score").cast("bigint"), F.col(seq).alias("_seq")
    )
