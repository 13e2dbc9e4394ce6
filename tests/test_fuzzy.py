import random

from pyspark.sql import functions as F

from ledgerlake.operators.fuzzy import deletions, match_subdivisions


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(text, subdivisions, k):
    """The stated ranking by comparing with every subdivision."""
    text = text.strip().lower()
    hits = []
    for code, name in subdivisions:
        name = name.strip().lower()
        points = 50 if text in name.split(";") or text == code.lower() else 0
        if text in name:
            points += max(5, 30 - 2 * name.index(text))
        if points:
            hits.append((-points, code))
    if not hits and k:
        near = [(edits(text, n.strip().lower()), c) for c, n in subdivisions]
        hits = [(d, c) for d, c in near if d <= k]
    return min(hits)[1] if text and hits else None


def check(spark, texts, subdivisions, k):
    names = spark.createDataFrame([(t,) for t in texts], "county string")
    dim = spark.createDataFrame(subdivisions, "code string, name string")
    got = dict(match_subdivisions(names, dim, k).collect())
    want = {t: brute(t, subdivisions, k) for t in texts if t is not None}
    assert got == {t: c for t, c in want.items() if c}


def test_ranking(spark):
    dim = [
        ("GB-YOR", "York"), ("GB-NYK", "North Yorkshire"), ("GB-ERY", "East Riding of Yorkshire"),
        ("GB-KEN", "Kent"), ("GB-BDG", "Barking;Dagenham"), ("GB-KEC", "Kensington"),
    ]
    texts = ["York", "Yorkshire", "kent", "Kemt", "ken", "gb-nyk", "Dagenham", "", " ", None, "Zzz"]
    check(spark, texts, dim, 2)
    check(spark, texts, dim, 0)


def test_against_all_pairs_on_random_texts(spark):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("abc ") for _ in range(n)).strip() or "a"

    dim = [(f"S-{i:02d}", word(rng.randrange(1, 9))) for i in range(40)]
    texts = list({word(rng.randrange(1, 9)) for _ in range(120)})
    for k in (0, 1, 2):
        check(spark, texts, dim, k)


def test_accents_do_not_matter(spark):
    names = spark.createDataFrame([("Cordoba",), ("ÎLE",)], "county string")
    dim = spark.createDataFrame([("A-X", "Córdoba"), ("F-I", "île")], "code string, name string")
    assert dict(match_subdivisions(names, dim, 0).collect()) == {"Cordoba": "A-X", "ÎLE": "F-I"}


def test_deletions(spark):
    got = spark.sql("select 'abc' as t").select(deletions(F.col("t"), 2)).first()[0]
    assert sorted(got) == sorted(["abc", "ab", "ac", "bc", "a", "b", "c"])
    assert spark.sql("select '' as t").select(deletions(F.col("t"), 2)).first()[0] == [""]


def test_no_all_pairs_join(spark):
    names = spark.createDataFrame([("York",)], "county string")
    dim = spark.createDataFrame([("A", "York")], "code string, name string")
    plan = match_subdivisions(names, dim)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_very_long_name_costs_nothing(spark):
    subdivisions = spark.createDataFrame([("S-1", "Kent")], "code string, name string")
    names = spark.createDataFrame([("x" * 5000,), ("kemt",)], "county string")
    got = {r["county"]: r["iso3166_2"] for r in match_subdivisions(names, subdivisions).collect()}
    assert got == {"kemt": "S-1"}
