"""A toxicity classifier that is regularised by counterfactual pairs.

Logistic regression on word and word-prefix counts. Training texts that mention an identity
term get a twin in which the term is swapped for another one; the squared difference of the
two scores is part of the loss, so that which group a sentence names has no say in it.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS`` per class, weighted
back to the true share of the classes; every document is scored, over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

SAMPLE_ROWS = 6000
FEATURES = 4096
LEAST_DOCS = 4
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Terms that name groups of people, by language; a swap stays within one.
IDENTITIES = (
    ("women", "men", "muslims", "christians", "jews", "immigrants", "gay", "straight", "black", "white"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its prefixes."""
    names = [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]
    return [zlib.crc32(n.encode()) for n in names]


def swapped(words: list[str], identities=IDENTITIES) -> list[str] | None:
    """The words with each identity term replaced by the next one of its list; None without any."""
    other = {t: terms[(i + 1) % len(terms)] for terms in identities for i, t in enumerate(terms)}
    return [other.get(w, w) for w in words] if any(w in other for w in words) else None


def fold(id_col: Column) -> Column:
    """Remainder of the checksum of an id as text; null for a null id."""
    return F.crc32(F.encode(id_col.cast("string"), "utf-8")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col="doc_id", text_col="text") -> DataFrame:
    """text, label and weight of at most about ``rows`` labelled rows per class outside the held-out fold.

    Rows are chosen by the hash of their id. Labels other than 0 and 1 are ignored, of
    several for one id the largest counts.
    """
    usable = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & (fold(F.col("_id")) != HELD_OUT))
        .groupBy("_id").agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, rows / n) for y, n in counts.items()}
    kept = F.lit(0.0)
    for y, s in share.items():
        kept = F.when(F.col("y") == y, F.lit(s)).otherwise(kept)
    drawn = usable.withColumn("share", kept).filter(
        F.pmod(F.xxhash64(F.lit(99), "_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )
    # about 2 * rows narrow rows, the bound given by the parameter
    return docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("text")).join(
        F.broadcast(drawn), F.col("_doc") == F.col("_id")
    ).select("text", "y", F.try_divide(F.lit(1.0), F.col("share")).alias("weight"))


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By feature the number of texts of either class that hold it, summed within the task."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            words = set(WORDS.findall(text.lower()))
            seen[y].update({f for w in words for f in features_of(w)})
    names = list(seen[0].keys() | seen[1].keys())
    yield pd.DataFrame({
        "feature": np.array(names, np.int64),
        "clean": np.array([seen[0][f] for f in names], np.int64),
        "toxic": np.array([seen[1][f] for f in names], np.int64),
    })


def choose_features(sample: DataFrame, most: int = FEATURES) -> list[int]:
    """The features whose share of texts differs most between the classes, by its z-score."""
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return []
    counts = sample.mapInPandas(_feature_counts, "feature long, clean long, toxic long")
    sums = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / (n[0] + n[1])
    spread = F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    z = F.abs(F.col("toxic") / n[1] - F.col("clean") / n[0]) / spread
    best = sums.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS).select("feature", z.alias("z"))
    rows = best.orderBy(F.desc("z"), "feature").limit(most).collect()
    return [r["feature"] for r in rows]


class Vectors:
    """Counts of the chosen features of texts, with a bounded memory of words seen."""

    def __init__(self, features: list[int], most_words: int = 200_000):
        self.index = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.most_words = most_words

    def __call__(self, words: list[str]) -> dict[int, float]:
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            places = self.known.get(word)
            if places is None:
                if len(self.known) >= self.most_words:
                    self.known.clear()
                places = tuple(self.index[f] for f in features_of(word) if f in self.index)
                self.known[word] = places
            for i in places:
                counts[i] = counts.get(i, 0) + n
        return {i: float(np.log1p(n)) for i, n in counts.items()}


def _packed(vector: dict[int, float] | None) -> tuple[bytes | None, bytes | None]:
    if vector is None:
        return None, None
    return np.array(list(vector), np.int32).tobytes(), np.array(list(vector.values()), np.float32).tobytes()


def fit(sample: DataFrame, features: list[int], penalty=1.0, decay=1e-3, rounds=300, rate=0.05) -> tuple[np.ndarray, float]:
    """Weights and offset; ``penalty`` weighs the squared score change of the swapped twins."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Vectors(features)
        for batch in batches:
            out = []
            for text, y, weight in zip(batch["text"], batch["y"], batch["weight"]):
                words = WORDS.findall(text.lower())
                twin = swapped(words)
                out.append((y, weight, *_packed(make(words)), *_packed(make(twin) if twin else None)))
            yield pd.DataFrame(out, columns=["y", "weight", "i", "x", "twin_i", "twin_x"])

    # a bounded number of rows, each with a bounded number of features
    rows = sample.mapInPandas(vectors, "y int, weight double, i binary, x binary, twin_i binary, twin_x binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["i"]), bytes(r["x"])))
    y = np.array([r["y"] for r in rows], dtype=float)
    weight = np.array([r["weight"] for r in rows])
    weight = weight / max(weight.sum(), 1e-9)

    def matrix(picked, i_name, x_name):
        i = [np.frombuffer(r[i_name], np.int32) for r in picked]
        x = [np.frombuffer(r[x_name], np.float32) for r in picked]
        at = np.repeat(np.arange(len(picked)), [len(v) for v in i])
        return at, np.concatenate([*i, np.zeros(0, np.int32)]), np.concatenate([*x, np.zeros(0, np.float32)]).astype(float)

    at, idx, val = matrix(rows, "i", "x")
    pairs = [r for r in rows if r["twin_i"] is not None]
    one, two = matrix(pairs, "i", "x"), matrix(pairs, "twin_i", "twin_x")
    d_at, d_idx, d_val = (np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), np.concatenate([one[2], -two[2]]))

    size = len(features)
    w, b = np.zeros(size), float(np.log(max((weight * y).sum(), 1e-6) / max((weight * (1 - y)).sum(), 1e-6)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        logit = np.bincount(at, val * w[idx], len(rows)) + b
        slope = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        grad = np.bincount(idx, val * slope[at], size) + decay * w
        if pairs:
            change = np.bincount(d_at, d_val * w[d_idx], len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(d_idx, d_val * change[d_at], size)
        g = np.append(grad, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, label="toxic", rows=SAMPLE_ROWS, id_col="doc_id", text_col="text"):
    """(features, weights, offset); without both classes among the labels a constant score."""
    sample = materialize(training_sample(docs, labels, label, rows, id_col, text_col), "toxicity-sample")
    features = choose_features(sample)
    if features:
        return features, *fit(sample, features)
    toxic = sample.agg(F.avg("y")).first()[0] or 0.0
    return [], np.zeros(0), 30.0 if toxic else -30.0


def scored(docs: DataFrame, model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and score of every row."""
    features, weights, offset = model
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = chosen.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Vectors(features)
        for batch in batches:
            logits = []
            for text in batch.pop("text"):
                vector = make(WORDS.findall(text.lower()))
                logits.append(offset + sum(weights[i] * x for i, x in vector.items()))
            yield batch.assign(score=1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30))))

    return chosen.mapInPandas(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, label="toxic", id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts get the score of a text without words. Rows without an id are not
    held out and never train. Repeated rows are scored each for itself. Without labels, or
    with one class only, all scores are equal.
    """
    model = train(docs, labels, label, id_col=id_col, text_col=text_col)
    return scored(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, label="toxic", id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that score under the threshold, columns unchanged."""
    features, weights, offset = train(docs, labels, label, id_col=id_col, text_col=text_col)
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        make = Vectors(features)
        for batch in batches:
            kept = []
            for text in batch.column(place).to_pylist():
                vector = make(WORDS.findall((text or "").lower()))
                logit = offset + sum(weights[i] * x for i, x in vector.items())
                kept.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))) < THRESHOLD)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
