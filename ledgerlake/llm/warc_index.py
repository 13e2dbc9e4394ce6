"""WARC archives written and read through an index.

The index comes first: record type, archive, offset, length, URL and digest follow from the
pages' metadata before a byte is written. Archives are then written in the index's order
by Spark's text writer, whose line end is the last byte of each record, so offsets are
exact on any file system. A read takes the selected index rows, sorts them by offset,
joins close ones to byte ranges, and fetches each range at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, shuffle_files_go
from .common import text_or_empty

LEAST_SHARED = 100
#: Records of an archive at most, about: their heads are some hundred bytes each.
ARCHIVE_RECORDS = 20_000
ARCHIVE_BYTES = 16 << 20
ROUNDS = 4
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, digest string, payload binary"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _head() -> Column:
    """Everything of a record before its payload."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    refers = F.when(
        F.col("record_type") == "revisit",
        F.concat(
            F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")), F.lit("\r\n")
        ),
    ).otherwise("")
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:null")), r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        body.cast("string"), F.lit("\r\n\r\n"), http,
    )


def _described(pages: DataFrame) -> DataFrame:
    html = text_or_empty("html")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(F.encode(html, "utf-8"), 256).alias("digest"),
    )


def _archive(archives: int) -> Column:
    return F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)).cast("int").alias("archive")


def build_index(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, int]:
    """The index, a row per page, and the number of archives.

    Of pages with equal payloads of ``LEAST_SHARED`` bytes or more the smallest id is the
    response (null ids come after all others; rows that repeat the smallest id are all
    responses), the others revisit it. A null html is an empty payload.
    """
    meta = materialize(_described(pages).drop("html"), "warc-pages")
    total, records = meta.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    # of many small pages the heads make up most of an archive, so their number is bounded too
    archives = max(1, -(-total // archive_bytes), -(-records // ARCHIVE_RECORDS))
    shared = meta.filter(F.col("payload_bytes") >= LEAST_SHARED)
    first = shared.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = first.filter("n > 1").drop("n")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = meta.join(first, "digest", "left").select(
        "page_id", "url", "payload_bytes", "digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
        _archive(archives),
    )
    payload = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    length = (F.octet_length(_head()) + payload + 4).cast("long")
    before = (
        Window.partitionBy("archive").orderBy("page_id", "digest", "url").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = typed.withColumn("length", length).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    )
    return materialize(placed, "warc-index"), archives


def write_archives(pages: DataFrame, index: DataFrame, archives: int, root: str) -> DataFrame:
    """Write the records in index order under ``root``, which is new; the index with each record's path."""
    # written out, so that Spark sees its size: if it is small, the payloads are not shuffled for this join
    revisits = materialize(
        index.filter("record_type = 'revisit'")
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
        .distinct(),
        "warc-revisits",
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    typed = (
        _described(pages)
        .join(revisits, same, "left")
        .withColumn("record_type", F.when(F.col("_digest").isNotNull(), "revisit").otherwise("response"))
    )
    payload = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    # the writer ends each line with the record's last line feed
    record = F.concat(_head(), payload, F.lit("\r\n\r"))
    placed = typed.select(_archive(archives), "page_id", "digest", "url", record.alias("record"))
    # a part of the archives at a time, so that only that part lies in shuffle files beside them
    rounds = min(ROUNDS, archives)
    for turn in range(rounds):
        with shuffle_files_go(pages.sparkSession):
            (
                placed.filter(F.col("archive") % rounds == turn)
                .repartition(archives, "archive")
                .sortWithinPartitions("archive", "page_id", "digest", "url")
                .select("archive", "record")
                .write.mode("append")
                .partitionBy("archive")
                .option("lineSep", "\n")
                .text(root)
            )
    spark = pages.sparkSession
    files = (
        spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, archive int")
        .option("pathGlobFilter", "*.txt").option("basePath", root).load(root)
        .select("path", "archive")
    ) if index.take(1) else spark.createDataFrame([], "path string, archive int")
    return index.join(files, "archive")


def byte_ranges(selected: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The selected records in order of offset, joined to ranges of at most about ``range_bytes``.

    Records further apart than ``gap_bytes`` are not joined; records indexed twice at one
    place are read once for each row.
    """
    order = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    fresh = (
        F.lag(end).over(order).isNull()
        | (F.col("offset") - F.lag(end).over(order) > gap_bytes)
        | (F.floor(F.col("offset") / range_bytes) != F.floor(F.lag("offset").over(order) / range_bytes))
    )
    marked = selected.select("path", "offset", "length").withColumn("fresh", fresh.cast("int"))
    return (
        marked.withColumn("range", F.sum("fresh").over(order))
        .groupBy("path", "range")
        .agg(
            F.min("offset").alias("start"),
            F.max(end).alias("stop"),
            F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
    )


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + name + rb": ([^\r]*)", head)
    return found[1].decode() if found else None


def _id(urn: str | None) -> int | None:
    text = (urn or "null").removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for path, start, stop, records in zip(batch["path"], batch["start"], batch["stop"], batch["records"]):
            store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with store.open_input_file(inner) as archive:
                data = archive.read_at(stop - start, start)
            out = []
            for r in records:
                record = data[r["offset"] - start : r["offset"] - start + r["length"]]
                head, _, rest = record.partition(b"\r\n\r\n")
                if not head.startswith(b"WARC/1.1\r\n") or not record.endswith(b"\r\n\r\n"):
                    raise ValueError(f"no record at {path}:{r['offset']}")
                payload = rest[: int(_field(head, b"Content-Length"))].partition(b"\r\n\r\n")[2]
                kind = _field(head, b"WARC-Type")
                out.append((
                    _id(_field(head, b"WARC-Record-ID")), kind,
                    _id(_field(head, b"WARC-Refers-To")),
                    _field(head, b"WARC-Payload-Digest").removeprefix("sha256:"),
                    payload if kind == "response" else None,
                ))
            frame = pd.DataFrame(out, columns=["page_id", "record_type", "refers_to", "digest", "payload"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(selected: DataFrame, tasks: int = 32) -> DataFrame:
    """The selected index rows' records: page_id, record_type, refers_to, digest and payload (null for revisits).

    Paths are opened by pyarrow's file systems (local or shared folders, HDFS, S3, GCS).
    """
    ranges = byte_ranges(selected).repartition(tasks, "path", "start")
    return ranges.mapInPandas(_fetch, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read every record back, and describe what was read."""
    index, archives = build_index(pages)
    stored = write_archives(pages, index, archives, scratch_path(pages.sparkSession, "warc"))
    read = materialize(
        read_records(stored, max(12, archives)).select(
            "page_id", "record_type", "refers_to", "digest",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest"),
        ),
        "warc-read",
    )
    whole = (
        read.filter("record_type = 'response'")
        .select(
            F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
        )
        .distinct()
    )
    revisits = read.filter("record_type = 'revisit'").join(
        whole, F.col("refers_to").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        read.filter("record_type = 'response'").select(columns)
        .unionByName(
            revisits.select(
                "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"),
                "record_type", "refers_to",
            )
        )
    )
