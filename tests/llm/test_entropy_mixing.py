import math
import random

from ledgerlake.llm import entropy_mixing as m

SCHEMA = "doc_id long, text string, source string, copies int, name string, size string"


def documents(n=900, seed=8):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 6 + ["a", "b", "é", "Z", None])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 3, 20, 50, 400])), source, 1, "x", "y"))
    rows += [rows[5]] * 3 + [(None, None, "a", 1, None, None), (None, "x y\tz\n", None, None, None, None), (5000, "  ", "none", 1, "x", "y")]
    return rows


def water(totals):
    names = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    caps, out, left = {s: 2 * totals[s] for s in names}, {}, 1.5 * sum(totals.values())
    while True:
        free = [s for s in names if s not in out]
        unit = left / max(1e-12, sum(weight[s] for s in free))
        full = [s for s in free if unit * weight[s] > caps[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = caps[s]
            left -= caps[s]


def test_targets_and_taken_words(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = m.mixture(df).collect()
    assert len(got) == len(rows)
    size = [len((r[1] or "").split()) for r in rows]
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), s) for r, s in zip(rows, size))
    totals = {}
    for r, s in zip(rows, size):
        totals[r[2]] = totals.get(r[2], 0) + s
    want = water(totals)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == totals[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(0.01 * want[s], 60)
    again = m.mixture(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_rates_are_tilted(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "a" if i % 2 else "b", 1, "x", "y") for i in range(400)]
    sized, _ = m.solve(spark.createDataFrame(rows, SCHEMA))
    histogram = spark.createDataFrame([(0, n, 10) for n in range(1, 41)], "index int, size long, n long")
    total = sum(10 * n for n in range(1, 41))
    for part in (0.01, 0.5, 1.0, 1.7, 1.99):
        plan = [{"total": total, "mean": total / 400, "target": part * total}]
        k = m.multipliers(histogram, plan)[0]
        words = sum(10 * n * min(2, math.exp(k * n / plan[0]["mean"])) for n in range(1, 41))
        assert math.isclose(words, part * total, rel_tol=1e-6)
    assert sized.count() == 400


def test_mixed_documents(spark):
    rows = documents(200)
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = m.mix_documents(df)
    assert mixed.schema == df.schema
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in m.mixture(df).collect())
    assert m.mix_documents(df.limit(0)).count() == 0 and m.mixture(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None, 1, "x", "y")], SCHEMA)
    assert [(r["target"], r["taken"]) for r in m.mixture(empty).collect()] == [(0.0, 0)]
