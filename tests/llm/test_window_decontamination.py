import random
import re
from collections import Counter

from ledgerlake.llm import window_decontamination as w

DOCS = "doc_id long, text string, row_key string, item_id int"
ITEMS = "item_id long, text string, fp string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws):
    k = min(5, len(ws))
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def brute(docs, items):
    best = {}
    for item, text, *_ in items:
        wanted = words(text)
        if not wanted:
            continue
        k = min(5, len(wanted))
        target = shingles(wanted)
        for doc, body, *_ in docs:
            ws = words(body)
            for s in range(max(1, len(ws) - len(wanted) + 1)):
                window = ws[s : s + len(wanted)]
                if len(window) < k:
                    continue
                mine = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
                both = sum((mine & target).values())
                alike = both / sum((mine | target).values())
                if alike >= 0.8:
                    best[doc, item] = max(best.get((doc, item), 0), alike)
    return best


def planted(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"wörd{i}" for i in range(150)]

    def some(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(some(rnd.randint(14, 40)))) for i in range(12)]
    items += [(20, "Tiny pair"), (21, None), (22, "..."), (23, "echo " * 20), (24, items[0][1])]
    docs = []
    for i in range(60):
        ws = some(rnd.randint(0, 120))
        if i % 3 == 0:
            source = rnd.choice(items[:12])[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                source[rnd.choice([0, -1, rnd.randrange(len(source))])] = "changed"
            at = rnd.randint(0, len(ws))
            ws[at:at] = source
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(ws)))
    docs += [(100, None), (101, ""), (102, "a tiny, PAIR!"), (103, items[3][1].upper()), (104, "Echo! " * 30)]
    docs += [(105, " ".join(items[5][1].split()[:-1])), docs[0], docs[0], (106, "x " * 30_000 + items[7][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = planted()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = w.contaminated(df, bench).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) and all(r["distance"] <= w.RADIUS for r in got)
    kept = w.drop_contaminated(df, bench)
    assert kept.schema == df.schema
    assert sorted(r[0] for r in kept.collect()) == sorted(d[0] for d in docs if d[0] not in {k[0] for k in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (None, None, None, None)], DOCS)
    bench = spark.createDataFrame([(1, "a b c d e f", "x")], ITEMS)
    assert w.contaminated(docs, bench.limit(0)).count() == 0
    assert w.contaminated(docs.limit(0), bench).count() == 0
    assert w.drop_contaminated(docs, bench.limit(0)).count() == 2
    assert [r[0] for r in w.drop_contaminated(docs, bench).collect()] == [None]
