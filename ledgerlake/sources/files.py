"""File scans and file sinks: CSV, Parquet, export, BI tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The dialect of the dropped CSV files.
CSV_DIALECT = {
    "header": "true", "sep": ",", "quote": '"', "escape": "\\", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
}
# The raw customer file: quotes inside a value are doubled and a value may span lines.
CSV_QUOTED = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}

DAMAGED = "_damaged"

#: Rows of a written CSV file at most: one whose values span lines is read whole by one task.
ROWS_PER_FILE = 1 << 18


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def as_text(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in schema.fields])


def in_header_order(names: list[str], schema: StructType) -> StructType:
    """The columns of a header with the types of ``schema``, others as text, and ``_damaged``.

    A column of ``schema`` that the header lacks is an error.
    """
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"columns missing in the header: {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    stored = StructType([StructField(n, types.get(n, StringType())) for n in names])
    return stored.add(DAMAGED, "string")


def _read_by_name(spark: SparkSession, path: str, schema: StructType, options: dict) -> DataFrame:
    """Columns found by their name in the header; files whose headers differ are an error."""
    names = spark.read.options(**options).csv(path).columns
    return (
        spark.read.options(**options)
        .schema(in_header_order(names, schema))
        .option("enforceSchema", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", DAMAGED)
        .csv(path)
        .select(*schema.names, DAMAGED)
    )


def read_csv_text(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False
) -> DataFrame:
    """Every value as text, found by the name in the header; ``_damaged`` holds malformed rows.

    A missing column is an error, one that ``schema`` lacks is left out. A field with
    nothing in it is null, a quoted empty one is the empty text. Values that may contain
    line breaks need ``multi_line``, which reads a file in one task; without it a large
    file is split.
    """
    options = {**CSV_QUOTED, "multiLine": str(multi_line).lower(), "nullValue": "\u0000"}
    return _read_by_name(spark, path, as_text(schema), options)


def read_csv_typed(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    multi_line: bool = False,
    damaged: bool = False,
) -> DataFrame:
    """Types from ``schema``, columns found by name, or all inferred with a second pass.

    With ``damaged`` malformed rows are kept in ``_damaged``.
    """
    options = {**CSV_QUOTED, "multiLine": str(multi_line).lower()}
    if schema is None:
        schema = spark.read.options(**options).option("inferSchema", "true").csv(path).schema
    rows = _read_by_name(spark, path, schema, options)
    return rows if damaged else rows.drop(DAMAGED)


def csv_row(*columns: str):
    """The columns as one CSV line in the dropped files' dialect."""
    return F.to_csv(F.struct(*columns), {k: v for k, v in CSV_DIALECT.items() if k != "header"})


def parse_csv_row(value: str, schema: StructType):
    """A line in the dropped files' dialect as a struct of trimmed fields."""
    return F.from_csv(F.col(value), ddl(schema), CSV_DIALECT)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, ``ROWS_PER_FILE`` rows a file at most.

    Any path Spark can reach, so also the export to a bucket or share.
    """
    writer = df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.options(header="true", quote='"', escape='"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Add uncompressed files to a directory, replacing none."""
    df.write.mode("append").option("compression", "none").parquet(path)


def parquet_to_csv(spark: SparkSession, source: str, target: str) -> None:
    write_csv(spark.read.parquet(source), target)


def read_parquet_or_empty(
    spark: SparkSession, path: str, schema: StructType, merge_schema: bool = False
) -> DataFrame:
    """The files under ``path``, or an empty typed frame if there are none yet.

    Any error but a missing path is raised. With ``merge_schema`` columns added by
    later writes are read too.
    """
    try:
        if merge_schema:
            return spark.read.option("mergeSchema", "true").parquet(path)
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def preview_table(spark: SparkSession, name: str, order: str, n: int = 10) -> DataFrame:
    """The first rows of a reporting table in a stated order."""
    return spark.sql(f"SELECT * FROM {name} ORDER BY {order} LIMIT {n}")


def create_bi_table(spark: SparkSession, name: str, schema: StructType, location: str) -> None:
    """An external Parquet table over existing files, for reporting tools."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl(schema)}) USING parquet LOCATION '{location}'")


def write_jdbc(df: DataFrame, url: str, table: str, columns: list[str], **options: str) -> list[str]:
    """Append the columns the relational table has; returns its columns ``df`` lacks.

    Plain INSERTs: a replayed batch inserts again, so give the table a unique key or
    load a staging table if that matters.
    """
    selected, missing = matching_columns(df, columns)
    selected.write.option("batchsize", "1000").options(**options).jdbc(url, table, mode="append")
    return missing


def matching_columns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` reduced to the wanted columns, names compared without case or underscores."""

    def plain(name: str) -> str:
        return name.replace("_", "").lower()

    have = {plain(c): c for c in df.columns}
    found = [F.col(have[plain(c)]).alias(c) for c in columns if plain(c) in have]
    return df.select(*found), [c for c in columns if plain(c) not in have]


#: Rows of a row group of a keyed table, about; a lookup by key reads one.
GROUP_BYTES = 4 << 20


def write_keyed(
    df: DataFrame, path: str, key: str, expected_keys: int | None = None, group_bytes: int = GROUP_BYTES, mode: str = "append"
) -> None:
    """Parquet made for lookups by ``key``: files sorted by it, a Bloom filter in each row group.

    Rows are dealt out by ranges of the key, so that a key lies in one file, and in one or two
    of its row groups by their bounds; the filter spares reading these for a key that is not
    there. ``expected_keys`` sizes it, by the number of rows of a group unless given.
    """
    writer = (
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode)
        .option("parquet.block.size", group_bytes)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
    )
    if expected_keys:
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", expected_keys)
    writer.parquet(path)
