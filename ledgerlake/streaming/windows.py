"""Event-time aggregates with bounded state: windows, sessions, and messages taken once.

The transformations work on streams and, without their watermark's effect, on tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def windowed(
    rows: DataFrame, time: str, keys: Sequence[str], measures: Sequence[Column],
    every: str = "1 hour", delay: str = "1 day", slide: str | None = None,
) -> DataFrame:
    """``window_start, window_end``, the keys and the measures of each window of ``every``.

    On a stream a window is closed, and its state dropped, when the latest time seen is
    ``delay`` past its end; rows that come later than that are left out. Rows without a
    time belong to no window.
    """
    window = F.window(time, every, slide) if slide else F.window(time, every)
    grouped = rows.withWatermark(time, delay).groupBy(window.alias("window"), *keys).agg(*measures)
    return _with_ends(grouped, keys)


def sessions(
    rows: DataFrame, time: str, keys: Sequence[str], measures: Sequence[Column],
    gap: str = "30 minutes", delay: str = "1 day",
) -> DataFrame:
    """``window_start, window_end``, the keys and the measures of each session.

    A session of a key goes on while rows follow one another within ``gap``; it ends a
    gap after its last row. State is kept for open sessions only, as in ``windowed``.
    """
    session = F.session_window(time, gap).alias("window")
    return _with_ends(rows.withWatermark(time, delay).groupBy(session, *keys).agg(*measures), keys)


def _with_ends(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    measures = [c for c in grouped.columns if c not in ("window", *keys)]
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *measures
    )


def taken_once(records: DataFrame, horizon: str, time: str = "timestamp") -> DataFrame:
    """Topic records without those sent again within ``horizon``.

    A record sent again has the same key and value; another value under a key is a change and
    stays. Two words of hash of both are the state of a record, which is dropped when the
    watermark, ``horizon`` behind the latest time seen, has passed it. Of a repeated record
    any one stays. Records without a key are told apart by their value.
    """
    words = {f"_w{i}": F.xxhash64(F.lit(i), F.col("key").isNull(), "key", "value") for i in (1, 2)}
    marked = records.withColumns(words).withWatermark(time, horizon)
    return marked.dropDuplicatesWithinWatermark(list(words)).drop(*words)


def closed_windows(
    windows: DataFrame, path: str, checkpoint: str, name: str, every: str | None = None
) -> StreamingQuery:
    """Append each window to a Parquet table once it is closed; the file sink writes it exactly once."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        windows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).queryName(name).trigger(**trigger).start()
    )


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The rows of a directory that Parquet files are added to, folders included."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
