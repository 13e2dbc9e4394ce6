"""Match free-text region names to subdivision codes without comparing all pairs.

A name is matched in three steps, the best hit winning and ties going to the
smallest code:

1. equal to the subdivision's name, one of its ``;``-separated alternatives, or code;
2. contained in the name: earlier positions score higher;
3. within ``max_distance`` edits of the name, fewer edits first.

All three are equi-joins. For 1 and 2 every substring of a subdivision name becomes
a needle with its single best code, so the lookup side is unique per needle. For 3
two texts within ``k`` edits share a text obtained by deleting at most ``k``
characters from each, so joining on these deletions misses no pair.

Exploded sides are joined by sort-merge on purpose: the planner does not foresee how
many rows an explode yields and might broadcast a side that is far too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fold_name
from ..session import materialize

# Points of an exact hit, of a hit at the start of the name, the loss
# per character of offset, and the least a contained text gets.
EXACT_POINTS, CONTAINED_POINTS, OFFSET_LOSS, LEAST_POINTS = 50, 30, 2, 5


def _best(code: str, points: Column) -> Column:
    """Smallest code among those with most points."""
    return F.min(F.struct((-points).alias("rank"), F.col(code).alias("code"))).alias("best")


def needle_index(subdivisions: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """``needle, best(rank, code)``: the best subdivision for each text that hits one.

    ``lengths`` are those of the names sought; needles of other lengths can hit none.
    """
    names = subdivisions.select(
        "code", fold_name("code").alias("code_text"), fold_name("name").alias("name")
    )
    starts = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")
    longest = F.length("name") - F.col("at") + 1
    if lengths is None:
        sought = F.sequence(F.lit(1), longest)
    else:
        sought = F.filter(F.lit(sorted(lengths)).cast("array<int>"), lambda n: n <= longest)
    needles = F.explode(
        F.transform(sought, lambda n: F.substring(F.col("name"), F.col("at"), n))
    ).alias("needle")
    position_points = F.greatest(
        F.lit(LEAST_POINTS), F.lit(CONTAINED_POINTS) - OFFSET_LOSS * (F.col("at") - 1)
    )
    is_exact = F.array_contains(F.split("name", ";"), F.col("needle")) | (
        F.col("needle") == F.col("code_text")
    )
    contained = (
        names.select("*", starts)
        .select("*", needles)
        .where(F.expr("locate(needle, name)") == F.col("at"))
        .select(
            "code",
            "needle",
            (position_points + F.when(is_exact, EXACT_POINTS).otherwise(0)).alias("points"),
        )
    )
    code_only = names.where(~F.contains(F.col("name"), F.col("code_text"))).select(
        "code", F.col("code_text").alias("needle"), F.lit(EXACT_POINTS).alias("points")
    )
    return contained.unionByName(code_only).groupBy("needle").agg(_best("code", F.col("points")))


def deletions(text: Column, k: int) -> Column:
    """All texts left after deleting at most ``k`` characters."""
    reached = F.array(text)
    latest = reached
    for _ in range(k):
        latest = F.array_distinct(F.flatten(F.transform(latest, _one_deletion)))
        reached = F.array_union(reached, latest)
    return reached


def _one_deletion(text: Column) -> Column:
    """Texts with one character less; none for the empty text."""
    positions = F.when(
        F.length(text) > 0, F.sequence(F.lit(1), F.length(text))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        positions,
        lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))),
    )


def near_matches(names: DataFrame, subdivisions: DataFrame, max_distance: int) -> DataFrame:
    """``name, best(rank, code)`` for each ``name, text`` within ``max_distance`` edits.

    An edit changes the length by one at most, so only texts of a length near that of some
    subdivision's name are expanded at all.
    """
    length = F.length(fold_name("name"))
    near = F.explode(F.sequence(length - max_distance, length + max_distance))
    reachable = subdivisions.select(near.alias("_length")).distinct()
    close = names.join(reachable, F.length("text") == F.col("_length"), "left_semi")
    left = close.select(
        "name", "text", F.explode(deletions(F.col("text"), max_distance)).alias("shared")
    )
    right = subdivisions.select("code", fold_name("name").alias("full_name")).select(
        "code", "full_name", F.explode(deletions(F.col("full_name"), max_distance)).alias("shared")
    )
    distance = F.levenshtein(F.col("text"), F.col("full_name"), max_distance)
    return (
        left.join(right.hint("merge"), "shared")
        .select("name", "code", distance.alias("distance"))
        .where(F.col("distance") >= 0)
        .groupBy("name")
        .agg(_best("code", -F.col("distance")))
    )


def match_subdivisions(names: DataFrame, subdivisions: DataFrame, max_distance: int = 2) -> DataFrame:
    """``name, iso3166_2`` for each distinct non-blank name that has a hit.

    ``names`` has one column. It is read once: its distinct values are stored, and all
    that follows grows with their number, not with the rows they come from.
    """
    source = names.columns[0]
    distinct = materialize(
        names.select(F.col(source).alias("name"), fold_name(source).alias("text"))
        .where(F.col("text") != "")
        .distinct(),
        "distinct-names",
    )
    # a number per distinct length
    lengths = [r[0] for r in distinct.select(F.length("text")).distinct().collect()]
    index = needle_index(subdivisions, lengths).withColumnRenamed("needle", "text")
    hits = distinct.join(index.hint("merge"), "text", "left").select("name", "text", "best")
    found = hits.where(F.col("best").isNotNull()).select("name", "best")
    if max_distance > 0:
        missed = hits.where(F.col("best").isNull()).select("name", "text")
        found = found.unionByName(near_matches(missed, subdivisions, max_distance))
    return found.select(F.col("name").alias(source), F.col("best.code").alias("iso3166_2"))


def add_subdivision(
    df: DataFrame, matches: DataFrame, column: str = "county"
) -> DataFrame:
    """Join the matches back; names without a hit get null."""
    return df.join(matches, column, "left")
