import random
import zlib

from ledgerlake.llm import counterfactual_toxicity as t
from ledgerlake.llm.queries import QUERIES

DOCS = "doc_id long, text string, score string, y int"
LABELS = "doc_id long, toxic int, quality int"


def sentences(n=1200, seed=3):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        toxic = rnd.random() < 0.2
        # a group is named in most toxic sentences and in few others
        if rnd.random() < (0.8 if toxic else 0.05):
            words.insert(rnd.randrange(len(words)), "women")
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "scummy", "rotten"]))
        docs.append((i, " ".join(words), "x", 1))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    return docs, labels


def test_scores(spark):
    docs, labels = sentences()
    docs += [(5000, None, None, None), (None, "vile women", "x", 1), docs[0]]
    labels += [(0, None, None), (None, 1, 1), (9999, 1, 1), (2, 7, 1)]
    rows = t.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    bad = {"vile", "scummy", "rotten"}
    truth = {d[0]: int(bool(bad & set((d[1] or "").split()))) for d in docs}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_counterfactuals_silence_identity_terms(spark):
    docs, labels = sentences()
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    sample = t.training_sample(df, marks, "toxic", 5000).cache()
    features = t.choose_features(sample)
    place = [features.index(f) for f in t.features_of("women") if f in features]
    change = {}
    for penalty in (0.0, 50.0):
        w, _ = t.fit(sample, features, penalty=penalty)
        change[penalty] = abs(sum(w[i] for i in place))
    assert change[50.0] < 0.3 * change[0.0]
    assert t.swapped(["the", "women", "x"]) == ["the", "men", "x"] and t.swapped(["x"]) is None


def test_without_usable_labels(spark):
    docs, labels = sentences(40)
    df = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in t.score_documents(df, none).collect()} == {0}
    clean = spark.createDataFrame([(i, 0, 1) for i in range(40)], LABELS)
    kept = t.keep_clean(df, clean)
    assert kept.schema == df.schema and kept.count() == 40
    assert t.score_documents(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    scores = QUERIES["op9_counterfactual_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scores.filter("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    toxic = sorted(r["score"] for r in rows if r["toxic"] == 1)
    clean = sorted(r["score"] for r in rows if r["toxic"] == 0)
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) >= 0.97
    assert sum(s >= 0.3 for s in clean) <= 0.02 * len(clean)
    assert sum(s >= 0.3 for s in toxic) >= 0.85 * len(toxic)
