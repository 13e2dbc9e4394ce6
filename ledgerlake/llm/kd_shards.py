"""K-d tree sharding: weighted medians split documents into shards of near-equal bytes.

A node that still holds more than one shard's bytes is cut in two along the metadata
dimension that is widest in it, at the weighted median (for an odd number of shards at
the matching quantile). The median is found by a radix search: the rows of a node are
ordered by a short list of digits, and one grouped sum per digit narrows the place of the
cut. So a level costs a few scans of a narrow metadata table with map-side sums; rows are
never sorted or gathered, and ties, however many, are cut like anything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import materialize
from .common import in_order, numbered, text_or_empty

DIMENSIONS = ("source", "lang", "n_chars")
#: The first digits are the value, in 2^18 steps of its node's range, then in 2^18 steps of such a
#: step, so that whole numbers are told apart in any range up to 2^36; the others are the bits of
#: the tie-breaker: the text's checksum, so that equal texts stay together, then the id's hash.
VALUE_STEPS = 1 << 18
VALUE_DIGITS = 2
TIE_SHIFTS = ((35, 18), (17, 18), (0, 17))
#: A table with a row per node is broadcast if there are at most so many shards.
BROADCAST_NODES = 100_000
DIGITS = [f"g{i}" for i in range(VALUE_DIGITS + len(TIE_SHIFTS))]


def _is_number(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, NumericType)


def _ranks(docs: DataFrame, name: str) -> DataFrame:
    """Each distinct text of a column and its place among them, found by ranges and not in one task."""
    values = docs.select(F.col(name).cast("string").alias("_value")).where("_value is not null").distinct()
    return materialize(in_order(materialize(values, "kd-values"), [F.col("_value").asc()], "_rank"), "kd-ranks")


def metadata(docs: DataFrame, dimensions=DIMENSIONS, id_col="doc_id", text_col="text") -> DataFrame:
    """One narrow row per document: id, size in bytes plus one, checksum, dimension codes.

    A code is a double in the order of the column: a number as it is, a text by its rank among
    the column's distinct texts, so that texts with a common beginning differ.
    """
    present = [d for d in dimensions if d in docs.columns]
    crc = F.crc32(F.encode(text_or_empty(text_col), "utf-8"))
    dims = []
    for i, d in enumerate(present):
        number = F.col(d).cast("double")
        value = F.when(~F.isnan(number), number) if _is_number(docs, d) else F.col(d).cast("string")
        dims.append(value.alias(f"d{i}"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        *(dims or [F.lit(0.0).alias("d0")]),
    )
    for i, d in enumerate(present):
        if not _is_number(docs, d):
            ranks = _ranks(docs, d)
            rows = rows.join(ranks, F.col(f"d{i}") == F.col("_value"), "left").withColumn(
                f"d{i}", F.col("_rank").cast("double")
            ).drop("_value", "_rank")
    codes = {f"d{i}": F.coalesce(f"d{i}", F.lit(-1.0)) for i in range(max(1, len(present)))}
    tie = F.shiftleft("text_crc32", 21).bitwiseOR(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 21)))
    return rows.withColumns(codes | {"tie": tie})


def _steps(place: Column) -> list[Column]:
    """A place from 0 to 1 as digits."""
    out, rest = [], place
    for _ in range(VALUE_DIGITS):
        scaled = rest * VALUE_STEPS
        step = F.greatest(F.lit(0), F.least(F.floor(scaled), F.lit(VALUE_STEPS - 1)))
        out.append(step)
        rest = scaled - step
    return out


def _split(rows: DataFrame, ranges: list[float], shards: int) -> DataFrame:
    """Every node of more than one shard becomes two nodes."""

    def per_node(table: DataFrame) -> DataFrame:
        # there are never more nodes than shards
        return F.broadcast(table) if shards <= BROADCAST_NODES else table

    dims = [f"d{i}" for i in range(len(ranges))]
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    width = [(F.col(f"max_{d}") - F.col(f"min_{d}")) / F.lit(r) for d, r in zip(dims, ranges)]
    widest = F.greatest(*width) if len(width) > 1 else width[0]
    nodes = (
        rows.filter("parts > 1")
        .groupBy("node", "parts")
        .agg(F.sum("size").alias("bytes"), *ends)
        .withColumn("widest", F.coalesce(*[F.when(w == widest, F.lit(i)) for i, w in enumerate(width)]))
        .select(
            F.col("node"),
            F.col("widest"),
            F.coalesce(*[F.when(F.col("widest") == i, F.col(f"min_{d}")) for i, d in enumerate(dims)]).alias("low"),
            F.coalesce(
                *[F.when(F.col("widest") == i, F.col(f"max_{d}") - F.col(f"min_{d}")) for i, d in enumerate(dims)]
            ).alias("span"),
            (F.col("bytes") * F.floor(F.col("parts") / 2) / F.col("parts")).alias("wanted"),
        )
    )
    value = F.coalesce(*[F.when(F.col("widest") == i, F.col(d)) for i, d in enumerate(dims)])
    place = F.when(F.col("span") > 0, (value - F.col("low")) / F.col("span")).otherwise(0.0)
    keyed = (
        rows.join(per_node(nodes.drop("wanted")), "node", "left")
        .withColumn("place", place)
    )
    keyed = keyed.withColumns({f"g{i}": step for i, step in enumerate(_steps(F.col("place")))})
    for i, (shift, bits) in enumerate(TIE_SHIFTS, VALUE_DIGITS):
        digit = F.shiftright("tie", shift).bitwiseAND(F.lit((1 << bits) - 1))
        keyed = keyed.withColumn(f"g{i}", digit)
    keyed = keyed.drop("place", "low", "span")

    cut = nodes.select("node", "wanted")
    order = Window.partitionBy("node").orderBy("digit")
    for i, g in enumerate(DIGITS):
        chosen = [f"c{j}" for j in range(i)]
        inside = keyed.filter("parts > 1").select("node", "size", *DIGITS[: i + 1]).join(per_node(cut), "node")
        if i:
            same = reduce(Column.__and__, [F.col(f"g{j}") == F.col(f"c{j}") for j in range(i)])
            inside = inside.filter(same)
        sums = inside.groupBy("node", "wanted", *chosen, F.col(g).alias("digit")).agg(F.sum("size").alias("w"))
        # the first digit at which the running sum reaches what is wanted; the last one at least
        running = sums.withColumn("upto", F.sum("w").over(order)).withColumn(
            "last", F.lead("digit").over(order).isNull()
        )
        reach = running.filter((F.col("upto") >= F.col("wanted")) | F.col("last"))
        first = F.min(F.struct("digit", (F.col("wanted") - F.col("upto") + F.col("w")).alias("rest")))
        cut = reach.groupBy("node", *chosen).agg(first.alias("at")).select(
            "node", *chosen, F.col("at.digit").alias(f"c{i}"), F.col("at.rest").alias("wanted")
        )
    left = F.struct(*DIGITS) <= F.struct(*[F.col(f"c{i}").alias(g) for i, g in enumerate(DIGITS)])
    half = F.floor(F.col("parts") / 2).cast("int")
    split = F.col("c0").isNotNull()
    return (
        keyed.join(per_node(cut.drop("wanted")), "node", "left")
        .withColumn("goes_left", F.when(split, left))
        .select(
            "doc_id", "size", "text_crc32", *dims, "tie",
            F.when(split, F.col("node") * 2 + F.when(F.col("goes_left"), 0).otherwise(1))
            .otherwise(F.col("node")).alias("node"),
            F.when(split, F.when(F.col("goes_left"), F.col("first")).otherwise(F.col("first") + half))
            .otherwise(F.col("first")).cast("int").alias("first"),
            F.when(split, F.when(F.col("goes_left"), half).otherwise(F.col("parts") - half))
            .otherwise(F.col("parts")).cast("int").alias("parts"),
        )
    )


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int = 256 << 20,
    dimensions=DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    ``shards`` fixes the number of leaves; without it, it is the total over ``target_bytes``.
    Sizes are UTF-8 bytes plus one, so a null or empty text weighs 1. A null dimension sorts
    before all values, a dimension the table lacks is left out, with none left the checksum
    alone decides. Rows with equal metadata are cut between texts, equal texts between ids;
    repeated rows are placed each for itself. An empty table gives no rows.
    """
    rows = materialize(metadata(docs, dimensions, id_col, text_col), "kd-metadata")
    dims = [c for c in rows.columns if c[0] == "d" and c[1:].isdigit()]
    whole = rows.agg(
        F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]
    ).first()
    parts = shards or max(1, -(-(whole["bytes"] or 0) // target_bytes))
    ranges = [whole[d] or 1.0 for d in dims]
    rows = rows.select(
        "*", F.lit(1).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(parts).cast("int").alias("parts")
    )
    for _ in range((parts - 1).bit_length()):
        rows = materialize(_split(rows, ranges, parts), "kd-level")
    placed = rows.select("doc_id", "size", "text_crc32", F.col("first").alias("shard"))
    return numbered(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, rows in slot order; ids must be unique."""
    keys = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    joined = docs.drop("shard", "slot").join(keys, id_col)
    joined.repartition("shard", F.floor(F.col("slot") / 50_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
