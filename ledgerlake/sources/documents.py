"""Reads of a keyed table: lookups, condition queries, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: rows shown by a preview unless asked otherwise.
PREVIEW_ROWS = 15
TAIL_ROWS = 100


def find_by_field(df: DataFrame, field: str, value) -> DataFrame:
    """Ids of the rows whose ``field`` equals ``value``; filter and columns reach the scan."""
    return df.where(F.col(field) == F.lit(value)).select("_id")


def find_by_id(df: DataFrame, value) -> DataFrame:
    return df.where(F.col("_id") == F.lit(value))


def find_by_key(df: DataFrame, key: str, *values) -> DataFrame:
    """Rows whose ``key`` is one of ``values``, compared as stored, so that the scan can leave out row groups."""
    return df.where(F.col(key).isin(*values))


def split_documents(df: DataFrame, value: str, name: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Rows with their JSON text as a document of any shape in ``name``, and rows whose text is none.

    A null text is no document. The documents can be stored and read as Parquet.
    """
    parsed = df.withColumn(name, F.try_parse_json(F.col(value)))
    return parsed.where(F.col(name).isNotNull()).drop(value), df.where(F.try_parse_json(F.col(value)).isNull())


def at(doc: str, path: str, kind: str) -> Column:
    """What a document holds at a path such as ``$.user.id``, as ``kind``; null if it is not there or no ``kind``."""
    return F.try_variant_get(F.col(doc), path, kind)


def fields(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The number of documents and the one schema that covers them all, found in one aggregate."""
    return df.agg(F.count(doc).alias("documents"), F.schema_of_variant_agg(doc).alias("shape"))


_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$lt": lambda c, v: c < v,
    "$le": lambda c, v: c <= v,
    "$gt": lambda c, v: c > v,
    "$ge": lambda c, v: c >= v,
    "$in": lambda c, v: c.isin(v),
    "$notin": lambda c, v: ~c.isin(v),
    "$like": lambda c, v: c.like(v),
    "$matches": lambda c, v: c.rlike(v),
}


def condition(where: dict) -> Column:
    """A condition document such as ``{"$and": [{"$gt": {"score": 85}}, …]}`` as a Column."""
    parts = []
    for op, arg in where.items():
        if op == "$and":
            parts.append(reduce(lambda a, b: a & b, map(condition, arg)))
        elif op == "$or":
            parts.append(reduce(lambda a, b: a | b, map(condition, arg)))
        elif op == "$not":
            parts.append(~condition(arg))
        elif op == "$exists":
            parts.append(F.col(arg).isNotNull())
        elif op == "$notexists":
            parts.append(F.col(arg).isNull())
        elif op in _COMPARE:
            parts.extend(_COMPARE[op](F.col(field), value) for field, value in arg.items())
        else:
            raise ValueError(f"unknown condition {op}")
    return reduce(lambda a, b: a & b, parts)


def search(df: DataFrame, select: list[str], where: dict) -> DataFrame:
    return df.where(condition(where)).select(*select)


def query(df: DataFrame, predicate: str | None = None) -> DataFrame:
    """All rows, or those for which an SQL predicate holds."""
    return df.where(predicate) if predicate else df


def peek(df: DataFrame, order: str | list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows in a stated order: a top-n per task, not a full sort."""
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, order: str, n: int = TAIL_ROWS) -> DataFrame:
    """The last ``n`` rows by ``order``, newest first."""
    return df.orderBy(F.col(order).desc()).limit(n)


def tail_with_total(df: DataFrame, order: str, n: int = TAIL_ROWS) -> DataFrame:
    """The last ``n`` rows, each with the number of all rows in ``total``."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return tail(df, order, n).withColumn("total", total)
