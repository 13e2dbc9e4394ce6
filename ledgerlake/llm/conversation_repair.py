"""Repair of conversations' turn structure by the auction algorithm for shortest paths.

A sound conversation is empty, or a system turn (or none) and then user and assistant turns in
alternation, an assistant's last. The edits of a conversation form a lattice of integer costs:
a node is a place between turns and what came last, an arc keeps, reroles or deletes the next
turn or inserts an empty one. An auction finds the cheapest edits: a path grows along an arc
that the node prices make tight, and where no arc is, the node's price rises and the path
shrinks by it. Converged prices are the costs to the end, so the tight arcs make up all cheapest
ways, of which the least in ASCII order is traced.

A conversation is cut into blocks of at most ``BLOCK`` turns, priced in parallel: a block's
costs from each entry to each exit join the auction over its conversation's chain of blocks, whose
prices go back into the blocks. A conversation of one block needs one auction. Only the repaired
lines of a conversation meet in one task, in order and a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialize
from .common import in_order

BLOCK = 1024
SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what a truncated turn adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# what came last: nothing, a system, a user, an assistant turn
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a made (reroled or inserted) turn, and after a kept turn by its initial.
MADE = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FAR = 1 << 60
#: The cost of ending in each state.
END = [0, FAR, FAR, 0]
#: A turn as a letter: three for each initial (sound, truncated, blank or duplicate).
INITIALS = "suax"
CODES = "ABCDEFGHIJKL"

Arc = tuple[str, int, int, int]  # edit, cost, turns passed, state after it


def arcs_of(code: str) -> list[list[Arc]]:
    """The arcs that pass a turn, by the state before it, in ASCII order of their edits."""
    kind, fault = divmod(CODES.index(code), 3)
    extra = TRUNCATED if fault == 1 else 0
    out = []
    for state in STATES:
        arcs = [("D", DELETE, 1, state)]
        if fault < 2:
            if INITIALS[kind] in KEPT[state]:
                arcs.append(("K", extra, 1, KEPT[state][INITIALS[kind]]))
            arcs.append(("R", REROLE + extra, 1, MADE[state]))
        out.append(arcs)
    return out


PASSING = {c: arcs_of(c) for c in CODES}
INSERTING = [("I", INSERT, 0, MADE[s]) for s in STATES]
LATTICE = {c: [sorted([*PASSING[c][s], INSERTING[s]]) for s in STATES] for c in CODES}


def auction(column: list[int], settled: list[bool], ways: list[list[tuple[int, int]]], beyond: list[list[tuple[int, int]]]):
    """Settle the prices of a column of nodes whose later columns are settled.

    ``ways`` has (cost, state) arcs within the column, ``beyond`` (cost, price) arcs that leave
    it. Prices must not exceed cost and price over any arc; they only rise. From each node in
    turn a path grows until it meets a settled node or leaves the column.
    """
    for origin in range(len(column)):
        path = [origin]
        while path and not settled[origin]:
            node = path[-1]
            best, target = min(
                min(((c + p, -1) for c, p in beyond[node]), default=(FAR, -1)),
                min(((c + column[s], s) for c, s in ways[node] if column[s] < FAR), default=(FAR, -1)),
            )
            if column[node] < best:
                column[node] = best  # no tight arc: the price rises and the path is contracted
                if len(path) > 1:
                    path.pop()
            elif target < 0 or settled[target]:
                for done in path:
                    settled[done] = True
            else:
                path.append(target)


def column_prices(leaving: list[list[tuple[int, int]]], inserts: bool, bound: int) -> list[int]:
    """The settled prices of a column: ``leaving`` are its arcs to settled prices, ``bound`` a price below all."""
    ways = [[(INSERT, MADE[s])] if inserts else [] for s in STATES]
    beyond = [[(c, p) for c, p in arcs if p < FAR] for arcs in leaving]
    # a node that cannot reach the end has no price; its arcs are left out
    reached = [bool(b) for b in beyond]
    for _ in STATES:
        reached = [r or any(reached[s] for _, s in ways[i]) for i, r in enumerate(reached)]
    column = [bound if r else FAR for r in reached]
    auction(column, [not r for r in reached], ways, beyond)
    return column


def prices(codes: str, end: list[int], last: bool) -> list[list[int]]:
    """The cost to the end from every place of a block and state; ``FAR`` where there is no way.

    Turns are inserted at each place but the end of a block that is not the last one, which is
    the beginning of the next. A column's prices start at the least of the next column, which
    no arc undercuts.
    """
    now = column_prices([[(0, e)] for e in end], last, min(end))
    columns = [now]
    for code in reversed(codes):
        leaving = [[(cost, now[after]) for _, cost, _, after in PASSING[code][s]] for s in STATES]
        now = column_prices(leaving, True, min(now))
        columns.append(now)
    return columns[::-1]


def trace(codes: str, columns: list[list[int]], last: bool, state: int) -> tuple[str, int]:
    """The least edits in ASCII order along tight arcs, and the state they end in."""
    edits = []
    for i, code in enumerate(codes):
        passed = 0
        while not passed:
            here = columns[i][state]
            for edit, cost, passed, after in LATTICE[code][state]:
                if columns[i + passed][after] < FAR and here == cost + columns[i + passed][after]:
                    break
            edits.append(edit)
            state = after
    while last and columns[-1][state] > 0:
        edits.append("I")
        state = MADE[state]
    return "".join(edits), state


def crossing(codes: str, last: bool) -> list[int]:
    """The least cost of a block from each entry to each exit (16 numbers, by entry)."""
    by_exit = [prices(codes, [0 if e == s else FAR for s in STATES], last)[0] for e in STATES]
    return [by_exit[e][s] for s in STATES for e in STATES]


def chain_ends(crossings: list[list[int]]) -> list[list[int]]:
    """The costs to the end of the conversation from the end of each of its blocks."""
    ends = [list(END)]
    for table in reversed(crossings[1:]):
        after = ends[-1]
        leaving = [[(table[4 * s + e], after[e]) for e in STATES if table[4 * s + e] < FAR] for s in STATES]
        ends.append(column_prices(leaving, False, min(after)))
    return ends[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with a fault planted by crc32 of "conv_id:turn" modulo 20; nulls count as one space.

    0 drops the turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    chosen = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    hurt = chosen.filter("kind != 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return hurt.drop("copy")


def examined(turns: DataFrame) -> DataFrame:
    """conv (a key that is never null), conv_id, pos, turn, role, text and fault of every turn.

    Turns are in order of turn (nulls first), role and text. The first fault counts: ``blank``,
    ``duplicate`` (role and text were there before) or ``truncated`` (no sentence ends it).
    """
    named = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        "conv_id", "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    ordered = in_order(named, [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "pos", "conv")
    words = [F.xxhash64(F.lit(w), "role", "text").alias(f"h{w}") for w in (1, 2)]
    told = materialize(ordered.select("*", *words), "turns")
    first = told.groupBy("conv", "h1", "h2").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    closed = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(closed == "", "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.substring(closed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return materialize(
        told.join(first, ["conv", "pos"], "left").select(
            "conv", "conv_id", "pos", "turn", "role", "text", fault.alias("fault")
        ),
        "examined",
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """conv, block, codes (a letter per turn) and last of every block."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), F.instr(F.lit(INITIALS), initial)).otherwise(4)
    fault = F.when(F.col("fault").isNull(), 1).when(F.col("fault") == "truncated", 2).otherwise(3)
    code = F.substring(F.lit(CODES), (kind - 1) * 3 + fault, F.lit(1))
    told = turns.select("conv", "pos", F.floor(F.col("pos") / BLOCK).cast("int").alias("block"), code.alias("code"))
    # a group is a block at most
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda t: t["code"])
    blocks = told.groupBy("conv", "block").agg(F.array_join(letters, "").alias("codes"))
    ends = told.groupBy("conv").agg(F.max("block").alias("final"))
    return blocks.join(ends, "conv").withColumn("last", F.col("block") == F.col("final"))


def planned(turns: DataFrame) -> DataFrame:
    """conv, block, entry (the state before it), edits and cost (from there to the end) of every block.

    ``turns`` are examined ones; ``illegal`` counts the block's neighbours whose initials may not
    follow one another, with the first turn of the next block.
    """
    blocks = materialize(_blocks(turns), "blocks")
    long = blocks.filter("final > 0")
    cross = F.udf(lambda codes, last: crossing(codes, bool(last)), "array<bigint>", useArrow=True)
    crossed = materialize(long.select("conv", "block", cross("codes", "last").alias("table")), "block-costs")
    chains = crossed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("chain"))
    tables = F.transform("chain", lambda b: b["table"])
    chained = F.udf(lambda t: chain_ends([list(map(int, x)) for x in t]), "array<array<bigint>>", useArrow=True)
    ends = materialize(
        chains.withColumn("tables", tables).select("conv", F.posexplode(chained("tables")).alias("block", "end")), "block-ends"
    )

    def solved(codes, last, end):
        columns = prices(codes, [int(e) for e in end], bool(last))
        ways = [trace(codes, columns, bool(last), s) if columns[0][s] < FAR else ("", s) for s in STATES]
        return columns[0], [w[1] for w in ways], [w[0] for w in ways]

    solve = F.udf(solved, "costs array<bigint>, exits array<int>, edits array<string>", useArrow=True)
    end = F.coalesce("end", F.array(*[F.lit(e).cast("long") for e in END]))
    initials = F.translate("codes", CODES, "".join(3 * i for i in INITIALS))
    # a block of one conversation in four states
    found = blocks.join(ends, ["conv", "block"], "left").select(
        "conv", "block", "final", solve("codes", "last", end).alias("way"), F.substring(initials, 1, 1).alias("head"),
        F.substring(initials, -1, 1).alias("tail"),
        (F.char_length(initials) - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).alias("within"),
    )
    found = materialize(found, "block-ways")
    several = found.filter("final > 0")
    ways = several.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "way.exits"))).alias("chain"))

    def entered(chain):
        states = [START]
        for exits in chain[:-1]:
            states.append(int(exits[states[-1]]))
        return states

    enter = F.udf(entered, "array<int>", useArrow=True)
    exits = F.transform("chain", lambda b: b["exits"])
    entries = ways.withColumn("exits", exits).select("conv", F.posexplode(enter("exits")).alias("block", "entry"))
    heads = several.select("conv", (F.col("block") - 1).alias("block"), F.col("head").alias("next"))
    joined = found.join(entries, ["conv", "block"], "left").join(heads, ["conv", "block"], "left")
    entry = F.coalesce("entry", F.lit(START))
    meets = F.concat("tail", "next")
    return materialize(
        joined.select(
            "conv", "block", entry.alias("entry"), F.get("way.edits", entry).alias("edits"),
            F.get("way.costs", entry).alias("cost"),
            (F.col("within") + F.when(meets.isin("su", "ua", "au"), 0).when(meets.isNotNull(), 1).otherwise(0)).alias("illegal"),
        ),
        "plans",
    )


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(conv, edit, role, text) of every edit, in order; each block's plan lies before its turns.

    role is that of the repaired turn, and null for a deleted one.
    """
    conv, state, edits = None, START, iter("")

    def inserted():
        nonlocal state
        for edit in edits:
            if edit != "I":
                return edit
            state = MADE[state]
            pending.append((conv, edit, ROLES[state], ""))
        return None

    pending: list = []
    for batch in batches:
        for key, entry, plan, role, text in zip(batch["conv"], batch["entry"], batch["edits"], batch["role"], batch["text"]):
            if plan is not None:
                inserted()  # those at the end of the conversation before
                conv, state, edits = key, int(entry), iter(plan)
            else:
                edit = inserted()
                if edit == "D":
                    pending.append((conv, edit, None, text))
                else:
                    state = MADE[state] if edit == "R" else KEPT[state][role[0]]
                    pending.append((conv, edit, ROLES[state] if edit == "R" else role, text))
            yield from pending
            pending.clear()
    inserted()
    yield from pending


def _with_plans(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Turns and plans of blocks, a conversation in one task and in order; batches pass through it."""
    heads = plans.select(
        "conv", (F.col("block").cast("long") * BLOCK).alias("pos"), F.lit(0).alias("kind"), "entry", "edits",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
    )
    rows = turns.select(
        "conv", "pos", F.lit(1).alias("kind"), F.lit(-1).alias("entry"), F.lit(None).cast("string").alias("edits"), "role", "text"
    )
    return heads.union(rows).repartition("conv").sortWithinPartitions("conv", "pos", "kind")


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, place (from 0, of repaired turns; null for deleted ones), edit, role and text of every edit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, place = [], None, 0
        for conv, edit, role, text in _edited(batches):
            place = place if conv == now else 0
            now = conv
            out.append((conv, None if edit == "D" else str(place), edit, role, text))
            place += edit != "D"
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])
                out = []
        yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])

    made = _with_plans(turns, plans).mapInPandas(run, "conv string, place string, edit string, role string, text string")
    return made.withColumn("place", F.col("place").cast("long"))


def digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, audit (all edits) and repaired_sha256 (of the repaired role:text lines) of every conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, audit, digest, lines = [], None, [], hashlib.sha256(), 0

        def closed():
            out.append((now, "".join(audit), digest.hexdigest()))

        for conv, edit, role, text in _edited(batches):
            if conv != now:
                if now is not None:
                    closed()
                now, audit, digest, lines = conv, [], hashlib.sha256(), 0
            audit.append(edit)
            if edit != "D":
                digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                lines += 1
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
                out = []
        if now is not None:
            closed()
        yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])

    return _with_plans(turns, plans).mapInPandas(run, "conv string, audit string, repaired_sha256 string")


def repair_report(turns: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each distinct conv_id of ``every``: gaps, faults, illegal neighbours, cost, audit, digest.

    ``turns`` has conv_id, turn, role and text; nulls in role and text count as one space, a
    null conv_id is a conversation of its own, and further columns are left out. Gaps are the
    turn numbers missing between the least and the largest. Repeated turns are duplicates. A
    conversation without turns has zeros, an empty audit and the digest of no text; an empty
    ``every`` gives no rows.
    """
    seen = examined(turns)
    plans = planned(seen)
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = seen.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).alias("gaps"), *counts)
    sums = plans.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost")
    )
    told = stats.join(sums, "conv").join(digests(seen, plans), "conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    ids = every.select("conv_id").distinct().withColumn("conv", key)
    return ids.join(told, "conv", "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the repaired turns; conv_id as in ``turns``, other columns go."""
    seen = examined(turns)
    made = repaired_turns(seen, planned(seen)).filter("place is not null")
    kind = turns.schema["conv_id"].dataType
    ident = F.when(F.col("conv") != "", F.expr("substring(conv, 2)"))
    return made.select(
        (ident if isinstance(kind, StringType) else ident.cast(kind)).alias("conv_id"), "place", "role", "text"
    )
