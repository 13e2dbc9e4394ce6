"""Messages to rows and back, with damaged input set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DAMAGED = "_damaged"


def decode_json(df: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """Add a struct ``record`` and ``_damaged``, the raw text where it is no valid JSON."""
    with_raw = StructType(list(schema.fields)).add(_DAMAGED, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED}
    parsed = F.from_json(F.col(value).cast("string"), with_raw, options)
    fields = F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields])
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("record", fields)
        .withColumn(_DAMAGED, F.col("_parsed")[_DAMAGED])
        .drop("_parsed")
    )


def reject_reason(key: str = "_id") -> Column:
    """Why a decoded row cannot be used, or null if it can."""
    return F.when(F.col(_DAMAGED).isNotNull(), "damaged").when(
        F.col("record")[key].isNull(), "missing key"
    )


def split_decoded(
    decoded: DataFrame, source: str, key: str = "_id", value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and dead letters with ``reason, raw, source``. No row is lost.

    Columns of ``decoded`` other than the message stay with the usable rows.
    """
    marked = decoded.withColumn("_reason", reject_reason(key))
    carried = [c for c in decoded.columns if c not in ("record", _DAMAGED, value)]
    good = marked.where(F.col("_reason").isNull()).select("record.*", *carried)
    bad = marked.where(F.col("_reason").isNotNull()).select(
        F.col("_reason").alias("reason"),
        F.col(value).cast("string").alias("raw"),
        F.lit(source).alias("source"),
    )
    return good, bad


def encode_json(*columns: str | Column, keep_nulls: bool = False) -> Column:
    """One JSON object per row from the given columns."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*columns), options)
