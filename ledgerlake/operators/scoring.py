"""The model hook: a scorer is a function that adds ``score`` to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import hash_score

Scorer = Callable[[DataFrame], DataFrame]

# Fixed value: scores above this are reported as possible fraud.
FRAUD_THRESHOLD = 85


def hash_scorer(key: str = "_id", salt: str = "") -> Scorer:
    """A stand-in model: a percentile that depends on the row's key only."""
    return lambda df: df.withColumn("score", hash_score(key, salt))


def pandas_scorer(predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str]) -> Scorer:
    """Score with any vectorised model; rows travel in Arrow batches.

    A null score says that the model could not score the row, for a null feature as a
    rule; such a row is no fraud.
    """

    @F.pandas_udf("bigint")
    def model(batch: pd.DataFrame) -> pd.Series:
        return predict(batch).astype("Float64").round().astype("Int64")

    return lambda df: df.withColumn("score", model(F.struct(*features)))


#: A model file is sent to every executor, so it may not be larger.
MODEL_BYTES = 256 << 20


def model_scorer(
    spark: SparkSession,
    path: str,
    load: Callable[[bytes], Any],
    predict: Callable[[Any, pd.DataFrame], pd.Series],
    features: Sequence[str],
    max_bytes: int = MODEL_BYTES,
) -> Scorer:
    """Score with a model kept in a file, wherever Spark can read.

    ``load`` makes the model from the file's bytes once in each task, not once in each batch;
    ``predict`` scores a batch of ``features``. Null scores as in ``pandas_scorer``.
    """
    stored = spark.read.format("binaryFile").load(path)
    sizes = [r["length"] for r in stored.select("length").take(2)]
    if len(sizes) != 1 or sizes[0] > max_bytes:
        raise ValueError(f"{path} must be one file of at most {max_bytes} bytes")
    held = spark.sparkContext.broadcast(bytes(stored.first()["content"]))

    @F.pandas_udf("bigint")
    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        ready = load(held.value)
        for batch in batches:
            yield predict(ready, batch).astype("Float64").round().astype("Int64")

    return lambda df: df.withColumn("score", model(F.struct(*features)))


def flag_fraud(df: DataFrame, scorer: Scorer, threshold: int = FRAUD_THRESHOLD) -> DataFrame:
    """Score every row; ``fraud`` is true above the threshold."""
    return scorer(df).withColumn("fraud", F.coalesce(F.col("score") > threshold, F.lit(False)))


def fraud_counts(flagged: DataFrame) -> DataFrame:
    """How many rows of a detection run were reported and how many are valid."""
    return flagged.agg(
        F.count_if("fraud").alias("fraud_count"),
        F.count_if(~F.col("fraud")).alias("valid_count"),
    )
