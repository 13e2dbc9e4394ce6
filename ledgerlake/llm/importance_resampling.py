"""Importance resampling towards a target distribution, over hashed word windows.

Texts are ASCII-lowered and cut by an untrained pre-tokenizer (a regex ``Split``), which gives
each word with its offsets. A feature is a window of words, known by the offsets of its first
and last word; its bucket is the CRC-32 of the words joined by spaces, carried on from word to
word. Bucket histograms of the raw and of the target corpus give each bucket a gain, the
logarithm of the ratio of its smoothed shares; a document weighs the sum of its gains. With a
Gumbel number from a hash of the id added, the highest scores are a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from ..session import materialize
from .common import in_order, text_or_empty

#: A word is a run of digits, small letters and anything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS = 10_000
#: The pre-tokenizer gets so many characters at a time, as its answer is far larger than they are.
PIECE = 1 << 20
UNIT = 1000
SEED = "2024"


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """(place, part) of the text cut between words; a part is longer than ``size`` only by one word."""
    start = 0
    while len(text) - start > size:
        gap = BETWEEN.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield start, text[start:end]
        start = end
    yield start, text[start:]


def word_offsets(text: str, splitter: pre_tokenizers.Split, size: int = PIECE) -> np.ndarray:
    """Start and end of each word of a lowered text, a row for each."""
    found = []
    for at, part in pieces(text, size):
        pairs = [offsets for _, offsets in splitter.pre_tokenize_str(part)]
        found.append(np.array(pairs, dtype=np.int64).reshape(-1, 2) + at)
    return np.concatenate(found)


def window_buckets(text: str, offsets: np.ndarray, least: int, most: int, buckets: int) -> np.ndarray:
    """The bucket of every window of ``least`` to ``most`` consecutive words."""
    crc32 = zlib.crc32
    words = [text[a:b].encode() for a, b in offsets.tolist()]
    sums = [crc32(w) for w in words]
    out = [sums] if least == 1 else []
    for length in range(2, most + 1):
        # the sum of a window is that of the one a word shorter, carried on over its last word
        sums = [crc32(w, crc32(b" ", s)) for s, w in zip(sums, words[length - 1 :])]
        if length >= least:
            out.append(sums)
    return np.concatenate([np.array(s, dtype=np.int64) for s in out]) % buckets


def _word(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(rows: DataFrame, least: int, most: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id (as text), n_words, n_features and the buckets of all features of every row."""
    kind = _word(buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = pre_tokenizers.Split(Regex(WORDS), behavior="removed", invert=True)
        for batch in batches:
            out = []
            for text in batch["text"]:
                lowered = text.encode().lower().decode()  # bytes: letters beyond ASCII stay
                offsets = word_offsets(lowered, splitter)
                found = window_buckets(lowered, offsets, least, most, buckets)
                out.append((len(offsets), len(found), found.astype(kind).tobytes()))
            made = pd.DataFrame(out, columns=["n_words", "n_features", "buckets"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], made], axis=1)

    chosen = rows.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return chosen.mapInPandas(run, "doc_id string, n_words long, n_features long, buckets binary")


def histogram(features: DataFrame, buckets: int) -> DataFrame:
    """bucket and n, the features in it; a task sends one row per bucket."""
    kind = _word(buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch["buckets"]:
                total += np.bincount(np.frombuffer(packed, dtype=kind), minlength=buckets)
        held = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    counted = features.select("buckets").mapInPandas(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket: a row per bucket reaches the driver."""
    spark = raw.sparkSession
    s = materialize(histogram(raw, buckets), "raw-histogram")
    t = materialize(histogram(target, buckets), "target-histogram")
    n_raw, n_target = (h.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for h in (s, t))
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    up, down = (F.coalesce(c, F.lit(0)).cast("double") + 1.0 for c in ("t", "s"))
    ratio = (up * F.lit(float(n_raw + buckets))) / (down * F.lit(float(n_target + buckets)))
    rows = both.select("bucket", F.floor(F.lit(float(UNIT)) * F.ln(ratio)).alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in rows], dtype=np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a row's features."""
    kind = _word(len(gain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["weight"] = [int(gain[np.frombuffer(b, dtype=kind)].sum()) for b in batch.pop("buckets")]
            yield batch

    return features.mapInPandas(run, "doc_id string, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    window: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rank is null unless it is drawn.

    Drawn are ``percent`` of the rows with ``least_words`` or more, by score, then id (a null
    id last); repeated rows count each. A null text has no words, and a text without features
    weighs 0. A null id hashes like an empty one. Without targets all buckets have gains by the
    raw counts alone; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = target.select(F.lit("").alias("doc_id"), F.col(target_text).alias("text"))
    raw, good = (
        materialize(featured(rows, *window, buckets, "doc_id", "text"), f"{name}-features")
        for name, rows in (("raw", named), ("target", wanted))
    )
    id_type = docs.schema[id_col].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(UNIT)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighted(raw, gains(raw, good, buckets)).withColumn("score", F.col("weight") + noise)
    scored = materialize(
        scored.withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumn("few", F.col("n_words") < least_words),
        "scores",
    )
    drawn = scored.filter("not few").count() * percent // 100
    order = [F.col("few").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = in_order(scored, order, "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return place.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged. Ids must be unique; null ids are never drawn."""
    taken = resampled(docs, target, id_col=id_col, text_col=text_col, **options).filter("rank is not null")
    ids = materialize(taken.select(F.col("doc_id").alias("_drawn")), "drawn")
    return docs.join(ids, docs[id_col] == ids["_drawn"], "left_semi")
