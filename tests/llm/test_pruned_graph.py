import numpy as np
from ledgerlake.llm import pruned_graph as p

SCHEMA = "vec_id long, embedding array<double>, label int, shard string, node string"


def clusters(n=400, width=16, seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, rng.choice([0.02, 0.08, 0.12]), width)
            label = rows[-1][2] if rng.random() < 0.3 else int(rng.integers(3))
        else:
            v, label = rng.normal(0, 1, width), int(rng.integers(3))
        rows.append((i * 5 % 1999, v.tolist(), label))
    rows += [(3000 + i, rows[7][1], rows[7][2]) for i in range(40)]
    rows += [(4000, (np.array(rows[7][1]) * 3).tolist(), rows[7][2])]
    return rows


def brute(rows, cosine):
    links = {}
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= cosine) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    root = {r[0]: r[0] for r in rows}
    for i, r in enumerate(rows):
        links[r[0]] = int(close[i].sum()) - 1
    while True:
        before = dict(root)
        for i, j in zip(*np.nonzero(close)):
            a, b = rows[i][0], rows[j][0]
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return links, root


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_against_brute_force(spark, monkeypatch):
    rows = clusters()
    links, root = brute(rows, 0.93)
    for cap in (1500, 60):  # one shard per label, and several levels
        monkeypatch.setattr(p, "CAP", cap)
        got = p.linked_vectors(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        found = sum(min(r["n_links"], links[r["vec_id"]]) for r in got)
        assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
        assert found >= 0.95 * sum(links.values())
        assert np.mean([r["component_id"] == root[r["vec_id"]] for r in got]) >= 0.95
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_a_shard_that_cannot_be_cut_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "CAP", 20)
    monkeypatch.setattr(p, "LEVELS", 1)
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + rng.normal(0, 0.01, 8)).tolist(), 1) for i in range(70)]
    got = p.linked_vectors(frame(spark, rows)).collect()
    assert np.mean([r["n_links"] for r in got]) >= 0.95 * 69
    assert {r["component_id"] for r in got} == {0}


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0]
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, one, None),
            (7, one, None), (8, one, 1), (9, one, 2), (10, [], 1), (11, [1.0, 2.0, 0.0], 1), (None, one, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in p.linked_vectors(frame(spark, rows)).collect()}
    assert got == {i: (0, i, True) for i in range(1, 12)} | {None: (0, None, None)}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in p.linked_vectors(frame(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert p.linked_vectors(frame(spark, [])).count() == 0


def test_a_dense_group_stays_connected(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, 64)
    rows = [(i, (middle + rng.normal(0, 0.12, 64)).tolist(), 1) for i in range(250)]
    rows += [(1000 + i, rng.normal(0, 1, 64).tolist(), 1) for i in range(300)]
    links, _ = brute(rows, 0.93)
    got = {r["vec_id"]: r["n_links"] for r in p.linked_vectors(frame(spark, rows)).collect()}
    assert sum(got.values()) >= 0.99 * sum(links.values()) > 50_000


def test_builds_that_miss_links_are_replaced_by_a_full_comparison(spark, monkeypatch):
    # the graph's search counts nothing and joins nothing
    def nothing(cosine, beam):
        return lambda cell: cell[["node"]].assign(links=0, root=cell["node"])

    monkeypatch.setattr(p, "_searched", nothing)
    monkeypatch.setattr(p, "CAP", 60)
    rows = clusters(200)
    links, root = brute(rows, 0.93)
    got = p.linked_vectors(frame(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], root[i]) for i in links}


def test_the_audit_counts_small_groups(spark):
    # one group of 60 is found, 40 pairs are not
    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(64)[0] + rng.normal(0, 0.001, 64)).tolist(), 1) for i in range(60)]
    for i in range(40):
        v = rng.normal(0, 1, 64)
        rows += [(100 + 2 * i, v.tolist(), 1), (101 + 2 * i, (v + 0.01).tolist(), 1)]
    _, classes = p.vector_classes(frame(spark, rows), "vec_id", "embedding", "label")
    found = spark.createDataFrame([(i, 59) for i in range(60)], "node long, links long")
    assert p.audit_recall(classes, found, 0.93) < 0.95
