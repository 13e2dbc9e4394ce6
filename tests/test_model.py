"""Tables against a plain dictionary that applies the same rows one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.dedup import keep_latest
from ledgerlake.operators.merge import merge
from ledgerlake.schemas import table
from ledgerlake.sources.tables import ChangeLog

SCHEMA = table(_id="string", a="long", b="string")


def random_rows(rng, n, start):
    """A third of the rows carry one key; any field may be missing."""
    return [
        (
            "hot" if rng.random() < 1 / 3 else f"k{rng.randrange(12)}",
            rng.choice([None, rng.randrange(100)]),
            rng.choice([None, "x", "y"]),
            start + i,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_log_views(spark, path, seed):
    rng = random.Random(seed)
    data = random_rows(rng, 60, 0)
    replaced, patched = {}, {}
    for key, a, b, _ in data:
        replaced[key] = (key, a, b)
        _, old_a, old_b = patched.get(key, (key, None, None))
        patched[key] = (key, old_a if a is None else a, old_b if b is None else b)

    log = ChangeLog(path("log"), SCHEMA)
    batches = {}
    for row in data:
        batches.setdefault(rng.randrange(4), []).append(row)
    order = list(batches)
    rng.shuffle(order)
    for batch in [*order, order[0]]:
        part = spark.createDataFrame(batches[batch], "_id string, a long, b string, n long")
        log.write_batch(part, batch, seq=F.col("n"))
    assert rows(log.current(spark)) == sorted(replaced.values(), key=repr)
    assert rows(log.current_patched(spark)) == sorted(patched.values(), key=repr)


@pytest.mark.parametrize("mode", ["replace", "update", "patch"])
def test_merges_one_after_the_other(spark, mode):
    rng = random.Random(mode)
    state, model = spark.createDataFrame([], SCHEMA), {}
    for step in range(3):
        data = random_rows(rng, 15, step * 100)
        source = keep_latest(
            spark.createDataFrame(data, "_id string, a long, b string, n long"), "_id", "n"
        )
        source = source.drop("n") if mode != "update" else source.select("_id", "a")
        for key, a, b, _ in {r[0]: r for r in data}.values():
            _, old_a, old_b = model.get(key, (key, None, None))
            if mode == "replace":
                model[key] = (key, a, b)
            elif mode == "update":
                model[key] = (key, a, old_b)
            else:
                model[key] = (key, old_a if a is None else a, old_b if b is None else b)
        state = merge(state, source, mode=mode)
    assert rows(state) == sorted(model.values(), key=repr)
