"""Keyed merge of a source into a target, as one full outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import keep_latest

MODES = ("replace", "update", "patch")


def split_missing_keys(df: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Rows that can be merged, and rows without a key for the dead-letter table."""
    return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())


def one_per_key(df: DataFrame, key: str, order: str | list[str] | None, name: str = "a merge") -> DataFrame:
    """Of rows that repeat a key the latest by ``order``; without an order a repeated key fails the job.

    Either way rows are grouped by the key as a merge on it needs them, so neither the shuffle
    nor the sort is made twice. Rows without a key are left as they are, or dropped by an order.
    """
    if order:
        return keep_latest(df.where(F.col(key).isNotNull()), key, order)
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    repeated = F.raise_error(F.concat(F.lit(f"{key} repeated in {name}: "), F.col(key).cast("string"))).cast("boolean")
    only = F.when(F.col("_place") == 1, F.lit(True)).when(F.col(key).isNull(), F.lit(True)).otherwise(repeated)
    return df.withColumn("_place", place).where(only).drop("_place")


def merge(
    target: DataFrame,
    source: DataFrame,
    key: str = "_id",
    mode: str = "update",
    newest_by: str | None = None,
    flags_to_keep: tuple[str, ...] = (),
    order: str | list[str] | None = None,
    target_order: str | list[str] | None = None,
    unique: tuple[str, ...] = (),
) -> DataFrame:
    """The target's rows after the merge, one per key.

    Of rows that repeat a key the latest by ``order`` (in the target ``target_order``) counts;
    without an order a repeated key fails the job. ``unique`` names sides ("target", "source")
    that are known to have none and are not looked at.

    * ``replace``: a matched row becomes the source row; columns the source lacks
      become null (insert-or-replace of whole documents).
    * ``update``: a matched row takes every column the source has, nulls included,
      and keeps the others.
    * ``patch``: like ``update``, but null source fields leave the target as it is.

    Unmatched source rows are inserted, unmatched target rows stay. With
    ``newest_by`` the source wins only where its value is not smaller than the
    target's. ``flags_to_keep`` names boolean columns that stay true once true.

    Each side is read and shuffled once; whether a side has the row is decided by
    its key, never by a null in some other column.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    source = source.where(F.col(key).isNotNull())
    if "source" not in unique:
        source = one_per_key(source, key, order, "a source")
    if "target" not in unique:
        target = one_per_key(target, key, target_order, "a target")
    t = target.select([F.col(c).alias(f"t_{c}") for c in target.columns])
    s = source.select([F.col(c).alias(f"s_{c}") for c in source.columns])
    joined = t.join(s, F.col(f"t_{key}") == F.col(f"s_{key}"), "full_outer")

    source_wins = F.col(f"s_{key}").isNotNull()
    if newest_by:
        source_wins = source_wins & (
            F.col(f"t_{key}").isNull()
            | F.col(f"t_{newest_by}").isNull()
            | (F.col(f"s_{newest_by}") >= F.col(f"t_{newest_by}"))
        )

    types = {f.name: f.dataType for f in target.schema.fields}

    def merged(name: str):
        if name == key:
            return F.coalesce(F.col(f"t_{key}"), F.col(f"s_{key}"))
        in_target, in_source = name in types, name in source.columns
        if not in_source:
            kept = F.col(f"t_{name}")
            return F.when(~source_wins, kept) if mode == "replace" else kept
        new = F.col(f"s_{name}")
        if not in_target:
            return F.when(source_wins, new)
        new, old = new.cast(types[name]), F.col(f"t_{name}")
        if mode == "patch":
            new = F.coalesce(new, old)
        value = F.when(source_wins, new).otherwise(old)
        if name in flags_to_keep:
            value = F.when(old, F.lit(True)).otherwise(value)
        return value

    names = target.columns + [c for c in source.columns if c not in types]
    return joined.select([merged(c).alias(c) for c in names])


def merge_into_catalog(source: DataFrame, table: str, key: str = "_id") -> None:
    """Update-or-insert into a table whose format supports row-level changes."""
    (
        source.alias("s")
        .mergeInto(table, F.expr(f"{table}.{key} = s.{key}"))
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )
