"""Mixing sources to target weights by entropy balancing.

Each source has a number of words to take. Of all document rates that give it, the one
closest to "every document once" in relative entropy is an exponential tilt in the
document's length, ``exp(k * size / mean size)``, here with the bound of two copies. The
multiplier k of each source solves the convex dual: a Newton iteration is one grouped sum
over a table of distinct (source, size), a few numbers per source come back. Rates become
whole copies by carrying the rounding error from long documents to short ones.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_DOCS = 20_000


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, source, size in words and a key of id, source and text; equal rows share the key."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        mix_key(id_col, text_col, source_col).alias("mix_key"),
    )


def mix_key(id_col="doc_id", text_col="text", source_col="source"):
    return F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col), F.col(source_col).isNull(), F.col(source_col))


def targets(totals: dict[str | None, int], weights=WEIGHTS, share: float = SHARE) -> dict[str | None, float]:
    """Words to take of each source: shares by weight, none above ``MOST_COPIES`` times its size.

    Weights go round the sources in code point order, null last.
    """
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(totals.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > MOST_COPIES * totals[s]}
        for s in sorted(full or open_, key=names.index):
            out[s] = float(MOST_COPIES * totals[s]) if full else unit * weight[s]
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def multipliers(histogram: DataFrame, plan: list[dict], tolerance: float = 1e-9, rounds: int = 80) -> list[float]:
    """Newton iterations for all sources at once; a bracket catches steps that leave it.

    ``histogram``: index, size, n. ``plan``: by index the total, mean and target.
    """
    spark = histogram.sparkSession
    k = [0.0 if p["target"] < MOST_COPIES * p["total"] else math.inf for p in plan]
    low, high = [-math.inf] * len(plan), [math.inf] * len(plan)
    # with nothing to take or to take from, or all of it twice, there is nothing to solve
    todo = {i for i, p in enumerate(plan) if 0 < p["target"] < MOST_COPIES * p["total"]}
    for i, p in enumerate(plan):
        if p["target"] <= 0:
            k[i] = -math.inf
    for _ in range(rounds):
        if not todo:
            break
        now = spark.createDataFrame([(i, k[i], plan[i]["mean"]) for i in sorted(todo)], "index int, k double, mean double")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("k") * x, F.lit(math.log(MOST_COPIES))))
        words = F.col("n") * F.col("size") * rate
        sums = (
            histogram.join(F.broadcast(now), "index")  # a row per source, from a list the driver holds
            .groupBy("index")
            .agg(
                F.sum(words).alias("value"),
                F.sum(F.when(F.col("k") * x < math.log(MOST_COPIES), words * x).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        for row in sums:
            i, gap = row["index"], row["value"] - plan[row["index"]]["target"]
            if abs(gap) <= tolerance * plan[i]["target"]:
                todo.discard(i)
                continue
            if gap < 0:
                low[i] = k[i]
            else:
                high[i] = k[i]
            step = k[i] - gap / row["slope"] if row["slope"] > 0 else math.nan
            if not low[i] < step < high[i]:
                if math.isinf(low[i]):
                    step = high[i] * 2 - 1
                elif math.isinf(high[i]):
                    step = low[i] * 2 + 1
                else:
                    step = (low[i] + high[i]) / 2
            k[i] = step
    return k


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one block's documents: the error goes on to the next shorter one."""
    rows = rows.sort_values(["size", "mix_key"], ascending=[False, True], kind="stable")
    error, copies = 0.0, []
    for size, rows_of, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()):
        weight = size * rows_of
        wanted = rate + (error / weight if weight else 0.0)
        copy = min(MOST_COPIES, max(0, math.floor(wanted + 0.5)))
        error += (rate - copy) * weight
        copies.append(copy)
    return rows.assign(copies=copies)[["mix_key", "copies"]]


def solve(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE):
    """(sized, copies): every row with its source's size and target; copies by key.

    One number per source is held on the driver, as the weights are. A null text has size 0;
    documents of size 0 are taken once and weigh nothing; sources whose texts are all empty
    have target 0; repeated rows share their number of copies; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("docs")).collect()
    totals = {r["source"]: r["total"] for r in found}
    wanted = targets(totals, weights, share)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    docs_of = {r["source"]: r["docs"] for r in found}
    plan = [
        {"total": totals[s], "mean": max(1.0, totals[s] / docs_of[s]), "target": wanted[s], "docs": docs_of[s]} for s in names
    ]
    sources = spark.createDataFrame(
        [(i, s, p["total"], p["target"]) for i, (s, p) in enumerate(zip(names, plan))],
        "index int, name string, source_size long, target double",
    )
    # sources and multipliers: a row per source, from lists the driver holds
    named = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    keyed = materialize(
        named.groupBy("index", "size", "mix_key").agg(F.count("*").alias("n")), "mix-keys"
    )
    histogram = materialize(keyed.groupBy("index", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    k = multipliers(histogram, plan)
    most = 700.0
    solved = spark.createDataFrame(
        [
            (i, max(-most, min(most, x)), p["mean"], max(1, -(-p["docs"] // BLOCK_DOCS)), math.isinf(x) and x > 0)
            for i, (x, p) in enumerate(zip(k, plan))
        ],
        "index int, k double, mean double, blocks int, full boolean",
    )
    tilt = F.exp(F.least(F.col("k") * F.col("size") / F.col("mean"), F.lit(math.log(MOST_COPIES))))
    rated = keyed.join(F.broadcast(solved), "index").select(
        "index", "size", "mix_key", "n",
        F.when(F.col("full") & (F.col("size") > 0), F.lit(float(MOST_COPIES))).otherwise(tilt).alias("rate"),
        F.pmod(F.col("mix_key"), F.col("blocks")).alias("block"),
    )
    copies = rated.groupBy("index", "block").applyInPandas(_round, "mix_key long, copies int")
    return named, copies


def mixture(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every row."""
    sized, copies = solve(docs, **columns)
    return sized.join(copies, "mix_key").select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix_documents(docs: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, columns unchanged."""
    _, copies = solve(docs, **columns)
    names = {k: v for k, v in columns.items() if k in ("id_col", "text_col", "source_col")}
    keyed = docs.select(F.struct("*").alias("row"), mix_key(**names).alias("mix_key"))
    taken = keyed.join(copies.filter("copies > 0"), "mix_key")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
