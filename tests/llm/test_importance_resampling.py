import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from ledgerlake.llm import importance_resampling as m
from tokenizers import Regex, pre_tokenizers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text, least, most):
    words = WORD.findall((text or "").encode().lower().decode())
    runs = [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 100 for r in runs]


def slow(docs, target, least, most, percent, least_words):
    raw = {i: slow_features(t, least, most) for i, (_, t) in enumerate(docs)}
    s = Counter(b for _, f in raw.values() for b in f)
    t = Counter(b for x in target for b in slow_features(x, least, most)[1])
    sums = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sums[0] + 100) / ((s[b] + 1) * (sums[1] + 100)))) for b in range(100)}
    out = []
    for i, (doc_id, _) in enumerate(docs):
        words, features = raw[i]
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        out.append([doc_id, words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(fit) * percent // 100
    for rank, r in enumerate(fit, 1):
        r.append(rank if rank <= drawn else None)
    return sorted((tuple((r + [None])[:6]) for r in out), key=repr)


def corpus():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "don't", "x_y", "日本", "3.5"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 20, 25, 120])))) for i in range(160)]
    docs += [(900, None), (901, ""), (902, "...!?"), (None, docs[9][1] + " null id"), docs[3], docs[3], (903, "a" * 30_000)]
    target = [" ".join(rnd.choice(words[:60]) for _ in range(30)) for _ in range(12)] + [None, ""]
    return docs, target


@pytest.mark.parametrize("window", [(1, 1), (1, 2), (2, 3)])
def test_against_brute_force(spark, window):
    docs, target = corpus()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, buckets string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = m.resampled(df, goal, percent=30, window=window, buckets=100).collect()
    assert sorted(map(tuple, got), key=repr) == slow(docs, target, *window, 30, 20)


def test_draw(spark):
    docs, target = corpus()
    docs = [d for i, d in enumerate(docs) if d[0] is not None and d not in docs[:i]]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, score int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = m.draw(df, goal, percent=50, buckets=100)
    want = {r[0] for r in slow(docs, target, 1, 1, 50, 20) if r[5]}
    assert got.schema == df.schema and {r[0] for r in got.collect()} == want and len(want) > 20


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = some.limit(0)
    assert m.resampled(none, some).count() == 0
    assert [r["rank"] for r in m.resampled(some, none, percent=100, least_words=1).collect()] == [1]


def test_words_of_long_texts_keep_their_offsets():
    rnd = random.Random(2)
    splitter = pre_tokenizers.Split(Regex(m.WORDS), behavior="removed", invert=True)
    for _ in range(50):
        text = "".join(rnd.choice("ab é日. \n_") for _ in range(rnd.randint(0, 200)))
        want = [w.span() for w in WORD.finditer(text)]
        for size in (1, 7, 50, 1000):
            assert [tuple(x) for x in m.word_offsets(text, splitter, size).tolist()] == want
    text = "x" * 100 + " y"
    assert m.word_offsets(text, splitter, 10).tolist() == [[0, 100], [101, 102]]
    assert len(m.window_buckets("", np.zeros((0, 2), np.int64), 1, 2, 10)) == 0
