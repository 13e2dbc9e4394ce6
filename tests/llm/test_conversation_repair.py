import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from ledgerlake.llm import conversation_repair as c

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, lines) of the cheapest edits, the least audit, by a search in order of both."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in (0, 3):
            return cost, audit, lines
        made = c.MADE[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, made, (*lines, f"{c.ROLES[made]}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, made, (*lines, f"{c.ROLES[made]}:{text}")))
                kept = c.KEPT[state].get(role[:1])
                if kept is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept, (*lines, f"{role}:{text}")))


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_report(turns, ids):
    out = []
    for conv in ids:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        seen, told = set(), []
        for _, _, role, text in rows:
            closed = text.rstrip(SPACES)
            fault = "blank" if not closed else "duplicate" if (role, text) in seen else "truncated" if closed[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        numbers = {t[1] for t in rows} - {None}
        faults = [t[2] for t in told]
        cost, audit, lines = cheapest(told)
        out.append((
            conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(n, seed=3, length=12):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rnd.randrange(3)
        for _ in range(rnd.randint(1, length)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Hi.", "Why?", "no end", "", " \t", None, f"t{rnd.randrange(99)}.", "end!\n", "é 日本"])
            rows.append((conv, rnd.choice([turn, turn, None]) if rnd.random() < 0.1 else turn, role, text))
            turn += rnd.choice([0, 1, 1, 1, 1, 2])
    return [*rows, (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), rows[0], (7000, None, None, None), (7001, 5, "user", "x" * 200_000)]


def checked(spark, rows):
    every = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", pos string, edits int")
    hurt = c.damaged(every)
    assert sorted(map(tuple, hurt.collect()), key=repr) == sorted(slow_damage(rows), key=repr)
    got = sorted(map(tuple, c.repair_report(hurt, every).collect()), key=repr)
    assert got == slow_report(slow_damage(rows), {r[0] for r in rows})
    return got


def test_against_brute_force(spark):
    got = checked(spark, conversations(150))
    assert {x for row in got for x in row[7]} == set("DIKR")


@pytest.mark.parametrize("block", [1, 3])
def test_long_conversations_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    checked(spark, conversations(40, seed=block, length=20))


def test_edges(spark):
    assert checked(spark, [(1, 3, "system", "S.")])[0][6:8] in ((4, "D"), (0, ""))
    none = spark.createDataFrame([], SCHEMA)
    assert c.repair_report(none, none).count() == 0 and c.repaired(none).count() == 0
    every = spark.createDataFrame([(1, 0, "user", "A.")], SCHEMA)
    row = c.repair_report(none, every).first()
    assert tuple(row)[1:8] == (0, 0, 0, 0, 0, 0, "") and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_every_short_lattice():
    """All conversations of up to three turns, whole and cut into two blocks."""
    roles, faults = ["system", "user", "assistant", "tool"], [None, "truncated", "blank"]
    letters = dict(zip(c.CODES, itertools.product(roles, faults)))
    for n in range(4):
        for codes in map("".join, itertools.product(c.CODES, repeat=n)):
            want = cheapest([(letters[x][0], "", letters[x][1]) for x in codes])[:2]
            columns = c.prices(codes, c.END, True)
            assert (columns[0][0], c.trace(codes, columns, True, 0)[0]) == want
            if n > 1:
                parts = codes[:1], codes[1:]
                ends = c.chain_ends([c.crossing(parts[0], False), c.crossing(parts[1], True)])
                first = c.prices(parts[0], ends[0], False)
                audit, state = c.trace(parts[0], first, False, 0)
                rest = c.trace(parts[1], c.prices(parts[1], ends[1], True), True, state)[0]
                assert (first[0][0], audit + rest) == want


def test_repaired_turns_are_sound(spark):
    rows = conversations(60, seed=9)
    got = c.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for conv, place, role, _ in sorted(map(tuple, got), key=lambda r: (repr(r[0]), r[1])):
        by.setdefault(conv, []).append((place, role[0]))
    for turns in by.values():
        assert [p for p, _ in turns] == list(range(len(turns)))
        initials = "".join(r for _, r in turns).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)


def test_a_long_block_ends_quickly():
    rnd = random.Random(5)
    codes = "".join(rnd.choice(c.CODES) for _ in range(50_000))
    columns = c.prices(codes, c.END, True)
    assert len(c.trace(codes, columns, True, 0)[0]) >= len(codes)
