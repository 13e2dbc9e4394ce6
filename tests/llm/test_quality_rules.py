import random
import re
from collections import Counter

from ledgerlake.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    """The measures that the contract names, by plain loops."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if found[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def texts():
    rnd = random.Random(4)
    words = ["the", "of", "and", "naïve", "#", "a|b", "x*y", "日本", "!", "word", "longer", "...", "•", "-"]
    out = ["", None, " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "l\nl\n \nl", "\n\n\n", "x\x0by\x0cz\rw"]
    for n in (10, 60, 200, 900):
        for _ in range(25):
            some = rnd.sample(words, rnd.randint(2, len(words))) + [f"w{i}" for i in range(rnd.choice([0, 50, 3000]))]
            out.append("".join(rnd.choice(some) + rnd.choice([" ", " ", "\n", "\t"]) for _ in range(n)))
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (None, "a b", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, _words int")
    got = q.quality_report(df)
    assert sorted((tuple(r[m] for m in ("doc_id", *MEASURES)) for r in got.collect()), key=repr) == sorted(
        ((r[0], *slow(r[1])) for r in rows), key=repr
    )


def test_a_very_long_text(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(60_000)}" for _ in range(300_000)]
    text = " ".join(words) + "\n" + " ".join(words[:5000]) + " " + "x" * 2_000_000
    got = q.quality_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got[m] for m in MEASURES) == slow(text)


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "of", *[f"word{rnd.randrange(9999)}" for _ in range(6)]]) for _ in range(n))


def test_the_table_decides(spark):
    clean = prose(200, 1)
    shouted = " ".join(w + "!!" for w in prose(200, 2).split())
    marked = " ".join(w + "***" for w in prose(200, 3).split())
    strange = " ".join(f"q{i}z" for i in range(200))
    bullets = "\n".join("- " + prose(6, i) for i in range(60))
    cut = "\n".join(prose(12, i) + "..." for i in range(40))
    lined = "\n".join([prose(20, 5)] * 3 + [prose(40, i) for i in range(6, 8)])
    long = " ".join(w * 4 for w in prose(300, 9).split())
    names = dict(enumerate([clean, shouted, marked, strange, bullets, cut, lined, long, None]))
    df = spark.createDataFrame([(i, t, 5) for i, t in names.items()], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in q.quality_report(df).collect()}
    assert got[0]["kept"] and got[0]["broken"] == []
    wanted = {1: "exclamations", 2: "symbols", 3: "stop_words", 4: "bullet_lines", 5: "cut_lines", 7: "word_length", 8: "few_words"}
    for i, name in wanted.items():
        assert name in got[i]["broken"] and not got[i]["kept"], (i, got[i])
    assert "repeated_lines" not in got[6]["broken"]
    kept = q.keep_good(df)
    assert kept.schema == df.schema and [tuple(r) for r in kept.filter("doc_id < 6").collect()] == [(0, clean, 5)]
    only_words = q.quality_report(df, rules=()).filter("kept").select("doc_id").collect()
    assert {r[0] for r in only_words} >= {0, 1, 2, 3}


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality_report(df).count() == 0 and q.keep_good(df).count() == 0


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = q.quality_report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
