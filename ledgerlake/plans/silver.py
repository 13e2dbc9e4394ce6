"""Bronze to silver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mask_tail, masked, pick_category
from ..operators.fuzzy import add_subdivision, match_subdivisions
from ..operators.lookup import add_country
from ..schemas import CATEGORIES, SILVER_CUSTOMERS
from ..session import materialize


def refine_customers(
    customers: DataFrame,
    countries: DataFrame,
    subdivisions: DataFrame,
    max_distance: int = 2,
    not_found: str = "not found",
    mask_account: int = 0,
    counties: DataFrame | None = None,
    with_subdivision: bool = True,
) -> DataFrame:
    """Enrich and mask customers that are already unique on their id.

    ``counties`` may name a cheaper source that has all their ``county`` values, such as
    the rows of the log whose current view the customers are: more names do no harm,
    and the deduplication then runs once only.

    The county matches are stored before they are joined back. They are one row per
    distinct county, and the planner then knows their size: small enough, they are
    broadcast and the customers are not shuffled at all. A caller that does not read the
    subdivision leaves the match out (``with_subdivision=False``); the column is null then.
    """
    if "id" in customers.columns and "_id" not in customers.columns:
        customers = customers.withColumnRenamed("id", "_id")
    refined = add_country(customers, countries, not_found=not_found)
    if with_subdivision:
        names = (customers if counties is None else counties).select("county")
        matches = materialize(match_subdivisions(names, subdivisions, max_distance), "county-matches")
        refined = add_subdivision(refined, matches)
    else:
        refined = refined.withColumn("iso3166_2", F.lit(None).cast("string"))
    refined = refined.withColumns({"birthdate": masked(8), "current_location": masked(4)})
    if mask_account:
        refined = refined.withColumn("account_number", mask_tail("account_number", mask_account))
    return refined.select(*SILVER_CUSTOMERS.names)


def refine_transactions(transactions: DataFrame, n_categories: int = len(CATEGORIES)) -> DataFrame:
    return transactions.withColumn("category", pick_category("_id", n_categories))


def blank_accounts(transactions: DataFrame) -> DataFrame:
    """Account columns stay, their content goes."""
    return transactions.withColumns(
        {"sender_account": F.lit(""), "receiver_account": F.lit("")}
    )
