import hashlib
import random

import numpy as np
from ledgerlake.llm import radix_suffix


def brute(rows):
    first = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            if doc is not None:
                first[data[p : p + 50]] = min(first.get(data[p : p + 50], doc), doc)
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if doc is not None and first[data[p : p + 50]] < doc:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed):
    rnd = random.Random(seed)

    def some(n):
        return "".join(rnd.choice("abcdefé \n") for _ in range(n))

    shared = [some(120), some(70), some(51), some(49), "ab" * 80, some(400), "x" * 90]
    rows = []
    for i in range(70):
        text = some(rnd.randint(0, 200))
        for _ in range(rnd.randint(0, 5)):
            s = rnd.choice(shared)
            text += s[rnd.randint(0, len(s) // 2) : rnd.randint(len(s) // 2, len(s))] + some(rnd.randint(0, 30))
        rows.append((i * 3 % 71, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (None, rows[4][1]), (103, ""), (103, "x" * 200), (104, "x" * 300)]
    rows += [(105, rows[3][1][:80]), (105, rows[3][1][:80]), (-5, rows[9][1])]
    return [(*r, 1, "k") for r in rows]


SCHEMA = "doc_id long, text string, spans int, row_key string"


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = texts(seed)
        got = radix_suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA)).drop("spans")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_slices_change_nothing(monkeypatch):
    text = "".join(random.Random(5).choice("abc ") for _ in range(3000)).encode()
    keys, entries = radix_suffix.anchors(text)
    windows = {w for e in entries for w in range(e["left"], e["left"] + e["more"] + 1)}
    assert windows == set(range(len(text) - 49))
    monkeypatch.setattr(radix_suffix, "SLICE", 100)
    sliced, cut = radix_suffix.anchors(text)
    assert {w for e in cut for w in range(e["left"], e["left"] + e["more"] + 1)} == windows
    assert set(sliced.tolist()) == set(keys.tolist())


def test_empty(spark):
    assert radix_suffix.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    short = spark.createDataFrame([(1, "a" * 49, 1, "k"), (2, "a" * 49, 1, "k")], SCHEMA)
    assert [r["n_removed"] for r in radix_suffix.repeated_passages(short).collect()] == [0, 0]


def test_digit_passes_find_the_least_holder():
    rnd = random.Random(11)
    data = "".join(rnd.choice("ab") for _ in range(400)) + "-" * 300 + "ab" * 150 + "-" * 120
    data = (data + data[100:220] + data[101:221]).encode()
    starts = np.array([rnd.randrange(len(data) - 49) for _ in range(3000)])
    docs = np.array([rnd.randrange(-5, 90) for _ in starts], np.int64)
    want = {}
    for s, d in zip(starts.tolist(), docs.tolist()):
        want[data[s : s + 50]] = min(d, want.get(data[s : s + 50], d))
    got = radix_suffix.first_holders(data, starts, docs)
    assert got.tolist() == [want[data[s : s + 50]] for s in starts.tolist()]
    assert radix_suffix.first_holders(b"", starts[:0], docs[:0]).tolist() == []


def test_filler_runs_in_many_texts(spark):
    rows = [(i, f"t{i} " + "-" * (50 + i % 40) + f" {i} " + "=" * (40 + i % 30), 1, "k") for i in range(300)]
    got = radix_suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA)).drop("spans")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
