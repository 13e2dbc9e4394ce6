import hashlib

from ledgerlake.llm import warc_index as w
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, archive int, record_type string"


def pages():
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(i, f"http://h/{i % 7} x\n", f"<html>{i}" + "a" * (i * 37 % 500)) for i in range(150)]
    rows += [(200 + i, None, long) for i in range(30)] + [(199, "u", long), (None, "u", long), (None, None, None)]
    rows += [(300, "u", "short"), (301, "u", "short"), (302, "u", ""), (303, "u", None), rows[3], rows[3], (199, "v", long)]
    rows += [(400, "u", "x" * 100), (401, "u", "x" * 100), (402, "u", "y" * 99), (403, "u", "y" * 99), (500, "big", "z" * 9_000_000)]
    return [(*r, 1, "x") for r in rows]


def expected(rows):
    least = {}
    for page, _, html, *_ in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        again = len(data) >= 100 and first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (64 << 20, 20_000):
        monkeypatch.setattr(w, "ARCHIVE_BYTES", size)
        got = w.archive_round_trip(df).collect()
        assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_selected_records_are_read_in_joined_ranges(spark, path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA)
    index, archives = w.build_index(df, archive_bytes=100_000)
    stored = w.write_archives(df, index, archives, path("warc")).cache()
    chosen = stored.filter("page_id % 10 = 0 AND record_type = 'response'")
    ranges = w.byte_ranges(chosen).collect()
    assert len(ranges) < chosen.count()
    assert all(a["stop"] <= b["start"] for a in ranges for b in ranges if a["path"] == b["path"] and a["start"] < b["start"])
    html = {r[0]: r[2] for r in rows}
    read = w.read_records(chosen, 3).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read} == {i: h for i, h in html.items() if i is not None and i % 10 == 0 and i < 200 or i in (200 if False else 300, 400, 500)}


def test_archives_are_well_formed(spark, path):
    rows = pages()[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    index, archives = w.build_index(df)
    stored = w.write_archives(df, index, archives, path("warc"))
    assert stored.count() == len(rows)
    for r in stored.select("path", "offset", "length").collect():
        with open(r["path"].removeprefix("file:"), "rb") as f:
            data = f.read()
        record = data[r["offset"] : r["offset"] + r["length"]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    whole = stored.groupBy("path").agg(F.sum("length").alias("n")).collect()
    for r in whole:
        with open(r["path"].removeprefix("file:"), "rb") as f:
            assert len(f.read()) == r["n"]


def test_empty(spark):
    assert w.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
