import random

import pytest
from ledgerlake.llm import chat_snapshots

SCHEMA = "conv_id long, turn long, role string, text string, block int, h1 string"


def brute(rows):
    talks = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            talks.setdefault(conv, set()).add((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [(r, t) for _, _, r, t in sorted(s)] for c, s in talks.items()}
    out = {}
    for c, mine in sorted(lists.items()):
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in lists.values())
        same = any(o == mine and d < c for d, o in lists.items())
        if not longer and not same:
            out[c] = (len(mine), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in mine))
    return out


def collapsed(df, **sizes):
    got = {}
    for r in chat_snapshots.format_chats(df, **sizes).orderBy("conv_id", "segment").collect():
        n, text = got.get(r["conv_id"], (r["n_turns"], ""))
        got[r["conv_id"]] = (n, text + r["rendered"])
    return got


@pytest.mark.parametrize("block, segment", [(1024, 256), (2, 2)])
def test_against_brute_force(spark, block, segment):
    rnd = random.Random(block)
    rows = []
    for conv in range(60):
        seed = rnd.randint(0, 6)
        for turn in range(rnd.randint(1, 7)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"say {seed} {turn}", 1, "x"))
    rows += rows[:10]  # repeated rows
    rows += [(None, 0, "user", "lost", 1, "x"), (90, None, None, None, 1, "x"), (90, 1, "user", "", 1, "x")]
    rows += [(91, 1, "user", "a", 1, "x"), (91, 1, "user", "b", 1, "x"), (92, 1, "user", "b", 1, "x")]  # a tie
    df = spark.createDataFrame(rows, SCHEMA)
    assert collapsed(df, block_turns=block, segment_turns=segment) == brute(rows)


def test_one_long_conversation_and_its_snapshots(spark):
    rows = [(c, t, "user", f"{t}" * 50, 1, "x") for c, n in ((1, 300), (2, 299), (3, 128), (4, 1)) for t in range(n)]
    got = collapsed(spark.createDataFrame(rows, SCHEMA), block_turns=64, segment_turns=100)
    assert list(got) == [1] and got[1][0] == 300


def test_empty(spark):
    assert collapsed(spark.createDataFrame([], SCHEMA)) == {}
