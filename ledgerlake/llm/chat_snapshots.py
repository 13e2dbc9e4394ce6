"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one.

Each turn's prefix of its conversation gets a rolling hash: the exclusive-or of the hashes
of (position, role, text) up to it, in two independent 64-bit words. A conversation whose
whole hash is the proper prefix of another one is a snapshot of it; an anti-join drops it.
Only hashes travel until the conversations to keep are known; then their texts are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

HASHES = ("h1", "h2")
#: The block of turns without a number, before all others.
NO_TURN = -(1 << 62)


def placed_turns(turns: DataFrame, block_turns: int = 1024) -> DataFrame:
    """conv_id, block, place (from 1, in the block), role, text and two words of hash of each turn.

    A conversation may hold any number of turns: it is cut into blocks of turn numbers, each
    numbered for itself. Rows equal in all four columns count once; a null role or text is an
    empty one; turns with the same number are ordered by role, then text, null numbers come
    first; rows without a conversation id belong to no conversation and are left out.
    """
    rows = (
        turns.select(
            F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
            text_or_empty("role").alias("role"), text_or_empty("text").alias("text"),
        )
        .filter(F.col("conv_id").isNotNull())
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(NO_TURN)))
        .repartition("conv_id", "block")
        .distinct()
    )
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    words = [F.xxhash64(F.lit(i), "role", "text").alias(h) for i, h in enumerate(HASHES)]
    placed = rows.select("conv_id", "block", F.row_number().over(within).alias("place"), "role", "text", *words)
    return materialize(placed, "chat-turns")


def block_starts(placed: DataFrame) -> DataFrame:
    """conv_id, block, n (turns in it), start (turns before it) and final of every block."""
    blocks = placed.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "conv_id", "block", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.lead("n").over(by_block).isNull().alias("final"),
    )
    return materialize(starts, "chat-blocks")


def prefix_hashes(placed: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, pos, last and the hashes of the prefix that ends there, of every turn; no texts.

    Blocks are hashed each for itself, and the totals of those before it carried over.
    """
    position = F.col("start") + F.col("place")
    hashed = placed.drop("role", "text").join(starts, ["conv_id", "block"]).select(
        "conv_id", "block", position.alias("pos"), (F.col("final") & (F.col("place") == F.col("n"))).alias("last"),
        *[F.xxhash64(F.lit(i), position, h).alias(h) for i, h in enumerate(HASHES)],
    )
    totals = hashed.groupBy("conv_id", "block").agg(*[F.bit_xor(h).alias(h) for h in HASHES])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the first block of a conversation, mostly the only one, needs nothing carried
    carried = totals.select("conv_id", "block", *[F.bit_xor(h).over(before).alias(f"before_{h}") for h in HASHES])
    carried = materialize(carried.filter(f"before_{HASHES[0]} is not null"), "chat-carried")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos")
    own = hashed.withColumns({h: F.bit_xor(h).over(upto) for h in HASHES})
    whole = {h: F.col(h).bitwiseXOR(F.coalesce(f"before_{h}", F.lit(0))) for h in HASHES}
    return own.join(carried, ["conv_id", "block"], "left").withColumns(whole).select("conv_id", "pos", "last", *HASHES)


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that prefix no longer one; of equal ones the smallest id."""
    ends = hashed.filter("last").groupBy("pos", *HASHES).agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.filter(~F.col("last")).select("pos", *HASHES).distinct()
    return ends.join(inner, ["pos", *HASHES], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def render(placed: DataFrame, starts: DataFrame, kept: DataFrame, segment_turns: int = 256) -> DataFrame:
    """The kept conversations as marked-up text, in segments of at most ``segment_turns`` turns.

    Texts are joined here and nowhere before, for the kept conversations alone.
    """
    line = F.concat(
        F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n")
    )
    blocks = materialize(starts.join(kept, "conv_id").select("conv_id", "block", "start", "n_turns"), "chat-kept")
    pos = F.col("start") + F.col("place")
    return (
        placed.select("conv_id", "block", "place", "role", "text").join(blocks, ["conv_id", "block"])
        .groupBy("conv_id", "n_turns", F.floor((pos - 1) / segment_turns).alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), line.alias("line")))).alias("lines"))
        .select(
            "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "segment",
            F.array_join(F.col("lines.line"), "").alias("rendered"),
        )
    )


def format_chats(turns: DataFrame, block_turns: int = 1024, segment_turns: int = 256) -> DataFrame:
    """conv_id, n_turns, segment and rendered text of every maximal conversation.

    Nulls, ties and repeated rows count as in ``placed_turns``; further columns are left out,
    and an empty table gives no rows.
    """
    placed = placed_turns(turns, block_turns)
    starts = block_starts(placed)
    hashed = materialize(prefix_hashes(placed, starts), "chat-prefixes")
    return render(placed, starts, maximal_conversations(hashed), segment_turns)
