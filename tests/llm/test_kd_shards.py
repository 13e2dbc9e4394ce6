import random
import zlib

import pytest
from ledgerlake.llm import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, node int"


def documents(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = "wörd " * rnd.randint(0, 60)
        hot = rnd.random() < 0.4
        rows.append((i, text, rnd.choice(["en", "de", None]), "hot" if hot else f"s{rnd.randint(0, 5)}", len(text), "x", 1, 1))
    rows += [(n + i, "copy " * 40, "en", "hot", 200, "x", 1, 1) for i in range(n // 3)]
    rows += [rows[0]] * 5 + [(None, None, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_near_equal_bytes_and_gapless_slots(spark, shards):
    rows = documents(600)
    got = kd_shards.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=shards).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    bytes_of, slots = {}, {}
    for r in got:
        bytes_of[r["shard"]] = bytes_of.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(bytes_of) == list(range(shards))
    largest = max(r["size"] for r in got)
    mean = sum(bytes_of.values()) / shards
    assert all(abs(b - mean) <= 5 * largest for b in bytes_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_target_bytes(spark):
    df = spark.createDataFrame(documents(300), SCHEMA)
    got = kd_shards.kd_shards(df, target_bytes=5000).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in got)
    assert len(got) == -(-total // 5000)
    assert max(r[1] for r in got) < 7000


def test_tiny_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert kd_shards.kd_shards(empty, shards=16).count() == 0
    one = spark.createDataFrame([(1, "a" * 100_000, None, None, None, None, None, None)], SCHEMA)
    assert [(r["size"], r["slot"]) for r in kd_shards.kd_shards(one, shards=16).collect()] == [(100_001, 0)]
    plain = spark.createDataFrame([(i, "same") for i in range(64)], "doc_id long, text string")
    sizes = [r[1] for r in kd_shards.kd_shards(plain, shards=4).groupBy("shard").count().collect()]
    assert sorted(sizes) == [16] * 4


def test_written_shards(spark, path):
    df = spark.createDataFrame([(i, f"text {i}", i) for i in range(50)], "doc_id long, text string, shard int")
    placed = kd_shards.kd_shards(df, shards=4)
    kd_shards.write_shards(df, placed, path("shards"))
    back = spark.read.parquet(path("shards"))
    assert back.count() == 50 and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


def plain_cut(rows, ranges, parts, first=0):
    """Shard by row number of a plain k-d cut; rows are (number, size, codes, tie)."""
    if parts == 1 or not rows:
        return {r[0]: first for r in rows}
    spans = [max(r[2][d] for r in rows) - min(r[2][d] for r in rows) for d in range(len(ranges))]
    width = [s / r for s, r in zip(spans, ranges)]
    d = width.index(max(width))
    rows = sorted(rows, key=lambda r: (r[2][d], r[3]))
    half = parts // 2
    wanted, upto, cut = sum(r[1] for r in rows) * half / parts, 0, 0
    while cut < len(rows) and upto < wanted:
        same = [r for r in rows[cut:] if (r[2][d], r[3]) == (rows[cut][2][d], rows[cut][3])]
        upto += sum(r[1] for r in same)
        cut += len(same)
    return plain_cut(rows[:cut], ranges, half, first) | plain_cut(rows[cut:], ranges, parts - half, first + half)


def test_against_a_plain_cut(spark):
    """Sources and languages with long common beginnings, and one text far longer than all others."""
    rnd = random.Random(7)
    rows = [
        (i, f"t{i} " * rnd.randint(1, 40), f"language-{rnd.randrange(9)}", f"https://example.org/dataset/{rnd.randrange(50):03d}")
        for i in range(400)
    ]
    rows += [(400, "x" * 3_000_000, "language-1", "https://example.org/dataset/007"), rows[5], (401, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = kd_shards.metadata(df).collect()
    dims = [c for c in told[0].asDict() if c[0] == "d" and c[1:].isdigit()]
    for d, c in zip(dims, (3, 2, None)):
        if c:  # ranks follow the texts
            assert [r[0] for r in sorted({(x[c] or "", y) for x in rows for y in [
                next(t[d] for t in told if t["doc_id"] == x[0])]})] == sorted({x[c] or "" for x in rows})
    codes = [(i, r["size"], [r[d] for d in dims], r["tie"]) for i, r in enumerate(told)]
    ranges = [max(c[2][d] for c in codes) - min(c[2][d] for c in codes) or 1.0 for d in range(len(dims))]
    want = plain_cut(codes, ranges, 8)
    got = {r["doc_id"]: r["shard"] for r in kd_shards.kd_shards(df, shards=8).collect()}
    assert got == {told[i]["doc_id"]: shard for i, shard in want.items()}
