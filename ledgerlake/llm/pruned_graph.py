"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label are cut into overlapping shards: a shard that is too large gets pivots,
and each of its vectors goes to the ``overlap`` closest ones, again and again until shards
fit. In each shard every vector's nearest and some random others are pruned robustly (a
neighbour is left out if one already chosen is closer to it by the factor ``ALPHA``); the
adjacency lists of all shards are united by vector. Each vector then searches its shards:
a greedy beam from the shard's medoid and from its own vertex, and from what it finds an
expansion through all neighbours within range. What is in range is verified in double precision.

A pair that lies in several shards is counted in the smallest of them, and a shard returns a
count and a root per vector, so pairs are never written out. A sample that grows with the
table is compared with all others to audit the recall, by link and by vector; below
``LEAST_RECALL`` the build is repeated with more overlap and a wider beam, and after the
third build all vectors of a label are compared in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

COSINE = 0.93
SLACK = 0.1
CAP = 1500
PIVOTS = 64
LEVELS = 4
OVERLAP = 3
MARGIN = 0.25
BEAM = 24
NEAREST, RANDOM, DEGREE, ALPHA = 48, 16, 24, 1.2
BRIDGES = 8
AUDIT_ROWS = 256
AUDIT_PART = 50
LEAST_RECALL = 0.95


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_classes(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes): equal vectors of one label are one class.

    A class is named by its smallest id, ``node``, and knows its ``size`` in ids. Rows that
    can link with nothing (see ``linked_vectors``) have no class.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = (
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    key = [F.when(usable, F.xxhash64(F.lit(i), F.col(label_col), vector)).alias(f"c{i}") for i in (1, 2)]
    named = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        vector.alias("vec"), *key,
    )
    once = named.filter("c1 IS NOT NULL").dropDuplicates(["vec_id", "c1", "c2"])
    classes = once.groupBy("c1", "c2").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("vec").alias("vec"), F.first("label").alias("label")
    )
    return named.drop("vec", "label"), classes


def _apart(pivots: np.ndarray, cosine: float) -> np.ndarray:
    """Pivots without those close to an earlier one: a dense group must not be cut by its own members."""
    sims, kept = pivots @ pivots.T, []
    for i in range(len(pivots)):
        if all(sims[i, j] < cosine for j in kept):
            kept.append(i)
    return pivots[kept]


def _nearest_pivots(overlap: int, apart: float):
    def run(batches):
        for batch in batches:
            out = []
            for shard, rows in batch.groupby("shard", sort=False):
                pivots = _apart(_unit(rows["pivots"].iloc[0]), apart)
                sims = _unit(rows["vec"]) @ pivots.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                score = np.take_along_axis(sims, best, axis=1)
                for j in range(best.shape[1]):
                    near = score[:, j] >= score[:, 0] - MARGIN
                    names = [f"{shard}.{p}" for p in best[near, j]]
                    out.append(rows.loc[near, ["node", "size", "vec"]].assign(shard=names))
            if out:
                yield pd.concat(out)[["node", "size", "vec", "shard"]]

    return run


def overlapping_shards(classes: DataFrame, overlap: int, cosine: float = COSINE) -> DataFrame:
    """node, size, vec, shard: every vector in up to ``overlap`` shards per level it went through.

    Pivots are at most ``PIVOTS`` vectors of the shard, chosen by hash, and not closer to each
    other than vectors that should link. A vector goes to its closest pivot and to the next
    ones if they are not ``MARGIN`` further off. After ``LEVELS`` levels a shard may still be
    too large, if its vectors hardly differ.
    """
    spread = F.concat_ws("/", "label", F.size("vec").cast("string"))
    members = classes.select("node", "size", "vec", spread.alias("shard"))
    for level in range(LEVELS):
        counts = members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > CAP)
        counts = materialize(counts, "large-shards")
        if not counts.take(1):
            break
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(level), "node"), "node")
        large = members.join(counts, "shard")
        picked = large.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
        wanted = F.greatest(F.lit(overlap + 1), F.ceil(F.col("n") * (2 * overlap) / CAP))
        pivots = picked.filter(F.col("place") <= wanted).groupBy("shard").agg(F.collect_list("vec").alias("pivots"))
        split = large.drop("n").join(pivots, "shard").mapInPandas(
            _nearest_pivots(overlap, cosine - SLACK), "node long, size long, vec array<double>, shard string"
        )
        small = members.join(counts, "shard", "left_anti").select("node", "size", "vec", "shard")
        members = materialize(small.unionByName(split), "shard-members")
    return members


def search_cells(members: DataFrame) -> DataFrame:
    """Members with their cell: a shard, or for a shard over ``CAP`` each pair of its blocks."""
    counts = members.groupBy("shard").agg(F.count("*").alias("n"))
    blocks = counts.select("shard", F.ceil(F.col("n") / CAP).cast("int").alias("blocks"))
    dealt = members.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = F.struct(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return (
        dealt.withColumn("other", F.explode(others)).withColumn("pair", cell)
        .select("node", "size", "vec", "shard", "block", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"))
    )


def prune(x: np.ndarray, ids: np.ndarray, cosine: float = COSINE) -> list[np.ndarray]:
    """Places of each vector's neighbours after robust pruning, with the reverse links.

    Members of a dense group fill each other's lists, and the group may fall apart into
    parts that do not know each other; so each vector also keeps ``BRIDGES`` links to
    any vectors near the range, chosen at random.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(0, int)]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near = np.argsort(-sims, axis=1, kind="stable")[:, : min(NEAREST, n - 1)]
    random = np.random.default_rng(int(ids.min() % (1 << 32)))
    chance = random.integers(0, n, (n, RANDOM))
    draw = np.where(sims >= cosine - SLACK, random.random((n, n), dtype=np.float32), 2)
    bridges = np.argpartition(draw, min(BRIDGES, n - 1), axis=1)[:, :BRIDGES]
    pool = np.concatenate([near, chance], axis=1)
    rows = np.arange(n)[:, None]
    pool = np.take_along_axis(pool, np.argsort(-sims[rows, pool], axis=1, kind="stable"), axis=1)
    apart = 2 - 2 * sims[rows, pool]
    alive = pool != rows
    adjacent: list[list[int]] = [[] for _ in range(n)]
    for _ in range(DEGREE):
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            break
        pick = pool[some, alive[some].argmax(axis=1)]
        for a, b in zip(some.tolist(), pick.tolist()):
            adjacent[a].append(b)
        between = 2 - 2 * sims[pick[:, None], pool[some]]
        alive[some] &= (ALPHA * between > apart[some]) & (pool[some] != pick[:, None])
    for a, b in zip(*np.nonzero(np.take_along_axis(draw, bridges, axis=1) < 2)):
        adjacent[a].append(int(bridges[a, b]))
    back: list[list[int]] = [[] for _ in range(n)]
    for a, row in enumerate(adjacent):
        for b in row:
            back[b].append(a)
    out = []
    for a in range(n):
        own, reverse = np.unique(adjacent[a]).astype(int), np.setdiff1d(back[a], adjacent[a]).astype(int)
        # hubs keep the closest of the links to them
        out.append(np.append(own, reverse[np.argsort(-sims[a, reverse], kind="stable")[:DEGREE]]))
    return out


def _adjacency(cosine: float):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node").sort_values("node")
        ids = cell["node"].to_numpy()
        lists = prune(_unit(cell["vec"]), ids, cosine)
        return pd.DataFrame({"node": ids, "near": [ids[i].tolist() for i in lists]})

    return run


def greedy_range(x: np.ndarray, links: np.ndarray, start: int, cosine: float, beam: int) -> np.ndarray:
    """By query (row) the cosine of every place its search saw, -2 elsewhere.

    ``links``: neighbours by place, padded by -1. All queries step together: the best place
    of the beam not yet opened is opened. Then all seen within ``SLACK`` of the range are opened.
    """
    n = len(x)
    seen = np.full((n, n), -2.0, dtype=np.float32)
    opened = np.zeros((n, n), dtype=bool)
    everyone = np.arange(n)
    seen[:, start] = x @ x[start]
    pool = np.full((n, beam), -1)
    pool[:, 0] = start
    # each query is a vertex of the graph itself, so it also starts there
    own = everyone[everyone != start]
    seen[own, own] = 1.0
    pool[own, 1] = own

    def look(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open places v for queries q; the new (query, place) pairs."""
        opened[q, v] = True
        near = links[v]
        qs, ns = np.broadcast_to(q[:, None], near.shape)[near >= 0], near[near >= 0]
        fresh = seen[qs, ns] == -2
        qs, ns = qs[fresh], ns[fresh]
        for a in range(0, len(qs), 200_000):
            seen[qs[a : a + 200_000], ns[a : a + 200_000]] = np.einsum(
                "ij,ij->i", x[qs[a : a + 200_000]], x[ns[a : a + 200_000]]
            )
        return qs, ns

    while True:
        worth = np.where(pool >= 0, seen[everyone[:, None], pool], -3)
        worth = np.where((pool >= 0) & ~opened[everyone[:, None], pool], worth, -3)
        best = worth.argmax(axis=1)
        q = np.flatnonzero(worth[everyone, best] > -3)
        if not len(q):
            break
        v = pool[q, best[q]]
        look(q, v)
        joined = np.concatenate([pool[q], links[v]], axis=1)
        score = np.where(joined >= 0, seen[q[:, None], joined], -3)
        order = np.argsort(-score, axis=1, kind="stable")
        joined = np.take_along_axis(joined, order, axis=1)
        score = np.take_along_axis(score, order, axis=1)
        # a place met twice has one score twice; the later one is dropped
        twice = np.zeros(joined.shape, bool)
        twice[:, 1:] = (joined[:, 1:] == joined[:, :-1]) | ((score[:, 1:] == score[:, :-1]) & (joined[:, 1:] == joined[:, :-1]))
        joined = np.where(twice, -1, joined)
        keep = np.argsort(twice, axis=1, kind="stable")[:, :beam]
        pool[q] = np.take_along_axis(joined, keep, axis=1)
    q, v = np.nonzero((seen >= cosine - SLACK) & ~opened)
    while len(q):
        look(q, v)
        q, v = np.nonzero((seen >= cosine - SLACK) & ~opened)
    return seen


def _searched(cosine: float, beam: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node").sort_values("node")
        ids, sizes, block = cell["node"].to_numpy(), cell["size"].to_numpy(), cell["block"].to_numpy()
        n, shard, cross = len(ids), cell["shard"].iloc[0], cell["low"].iloc[0] != cell["high"].iloc[0]
        x = _unit(cell["vec"])
        place = {v: i for i, v in enumerate(ids.tolist())}
        near = [[place[v] for v in row if v in place] for row in cell["near"]]
        links = np.full((n, max(1, *map(len, near))) if n > 1 else (n, 1), -1)
        for i, row in enumerate(near):
            links[i, : len(row)] = row
        middle = int((x @ x.mean(axis=0)).argmax())
        seen = greedy_range(x, links, middle, cosine, beam)
        a, b = np.nonzero(np.triu((seen >= cosine - 1e-3) | (seen.T >= cosine - 1e-3), 1))
        raw = np.stack([np.asarray(v, dtype=np.float64) for v in cell["vec"]])
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        found = np.zeros(len(a))
        for s in range(0, len(a), 200_000):
            i, j = a[s : s + 200_000], b[s : s + 200_000]
            found[s : s + 200_000] = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j])
        a, b = a[found >= cosine], b[found >= cosine]
        # counted here only if no smaller shard holds both, and by the cell of their two blocks
        names = sorted({s for row in cell["shards"] for s in row})
        code = {s: i for i, s in enumerate(names)}
        held = np.full((n, max(len(r) for r in cell["shards"])), -1)
        for i, row in enumerate(cell["shards"]):
            held[i, : len(row)] = [code[s] for s in row]
        least = np.full(len(a), len(names))
        for i in range(held.shape[1]):
            for j in range(held.shape[1]):
                both = (held[a, i] == held[b, j]) & (held[a, i] >= 0)
                least = np.where(both & (held[a, i] < least), held[a, i], least)
        own = (least == code[shard]) & ((block[a] != block[b]) if cross else (block[a] == block[b]))
        links_of = np.bincount(a[own], sizes[b[own]], n) + np.bincount(b[own], sizes[a[own]], n)
        root = np.arange(n)
        while True:
            least_root = root.copy()
            np.minimum.at(least_root, a, root[b])
            np.minimum.at(least_root, b, root[a])
            least_root = least_root[least_root]
            if (least_root == root).all():
                break
            root = least_root
        return pd.DataFrame({"node": ids, "links": links_of.astype(np.int64), "root": ids[root]})

    return run


def near_vectors(classes: DataFrame, cosine: float, overlap: int, beam: int) -> DataFrame:
    """node, links, root per class and cell."""
    cells = materialize(search_cells(overlapping_shards(classes, overlap, cosine)), "search-cells")
    key = ["shard", "low", "high"]
    built = cells.groupBy(*key).applyInPandas(_adjacency(cosine), "node long, near array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    held = cells.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    ready = cells.join(united, "node").join(held, "node")
    return ready.groupBy(*key).applyInPandas(_searched(cosine, beam), "node long, links long, root long")


def _compared(cosine: float):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("node")
        ids, sizes, block = cell["node"].to_numpy(), cell["size"].to_numpy(), cell["block"].to_numpy()
        n, cross = len(ids), cell["low"].iloc[0] != cell["high"].iloc[0]
        x = _unit(cell["vec"])
        close = x @ x.T >= cosine
        close &= (block[:, None] != block) if cross else ~np.eye(n, dtype=bool)
        root = np.arange(n)
        a, b = np.nonzero(np.triu(close, 1))
        while True:
            least_root = root.copy()
            np.minimum.at(least_root, a, root[b])
            np.minimum.at(least_root, b, root[a])
            least_root = least_root[least_root]
            if (least_root == root).all():
                break
            root = least_root
        return pd.DataFrame({"node": ids, "links": (close @ sizes).astype(np.int64), "root": ids[root]})

    return run


def all_near_vectors(classes: DataFrame, cosine: float) -> DataFrame:
    """node, links, root per class and cell, without a graph: each label is compared in pairs of blocks."""
    spread = F.concat_ws("/", "label", F.size("vec").cast("string"))
    cells = search_cells(classes.select("node", "size", "vec", spread.alias("shard")))
    return cells.groupBy("shard", "low", "high").applyInPandas(_compared(cosine), "node long, links long, root long")


def _asked_links(cosine: float):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        asked, others = cell[cell["asked"]], cell[~cell["asked"]]
        if not len(asked) or not len(others):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        nodes = asked["node"].to_numpy()
        close = (_unit(asked["vec"]) @ _unit(others["vec"]).T >= cosine) & (nodes[:, None] != others["node"].to_numpy())
        return pd.DataFrame({"node": nodes, "links": (close @ others["size"].to_numpy()).astype(np.int64)})

    return run


def true_links(classes: DataFrame, cosine: float) -> DataFrame:
    """node and exact number of links of a sample that grows with the table, compared in blocks with all.

    The sample is one class in ``AUDIT_PART`` by hash; more of a table that would give fewer
    than ``AUDIT_ROWS``.
    """
    part = max(1, min(AUDIT_PART, classes.count() // AUDIT_ROWS))
    spread = F.concat_ws("/", "label", F.size("vec").cast("string"))
    rows = classes.select("node", "size", "vec", spread.alias("shard"))
    sample = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(part)) == 0

    def blocks(of: str) -> Column:
        return F.ceil(F.col(of) / CAP).cast("int")

    counts = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(sample).alias("m")).filter("m > 0")
    dealt = rows.join(counts.select("shard", blocks("n").alias("n"), blocks("m").alias("m")), "shard")
    place = F.xxhash64(F.lit(6), "node")
    mine = dealt.filter(sample).select(
        "node", "size", "vec", "shard", F.lit(True).alias("asked"), F.pmod(place, "m").cast("int").alias("low"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("high"),
    )
    others = dealt.select(
        "node", "size", "vec", "shard", F.lit(False).alias("asked"),
        F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("low"), F.pmod(place, "n").cast("int").alias("high"),
    )
    both = mine.unionByName(others)
    counted = both.groupBy("shard", "low", "high").applyInPandas(_asked_links(cosine), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def audit_recall(classes: DataFrame, found: DataFrame, cosine: float) -> float:
    """The lesser of the sample's shares of true links that were found, of all links and as a mean over
    the vectors that have any; 1 if there are none."""
    true = true_links(classes, cosine).withColumnRenamed("links", "wanted").filter("wanted > 0")
    met = F.least(F.coalesce("links", F.lit(0)), "wanted")
    both = true.join(found, "node", "left").agg(F.sum(met) / F.sum("wanted"), F.avg(met / F.col("wanted"))).first()
    return 1.0 if both[0] is None else min(both)


def linked_vectors(
    rows: DataFrame, cosine: float = COSINE, id_col="vec_id", vector_col="embedding", label_col="label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Only vectors of equal labels and equal length are compared. A vector that is null, zero,
    or holds null or non-finite components links with nothing, nor does a row without label
    or id. Rows equal in id, label and vector count as one vector and get equal results;
    equal vectors of other ids are linked. An empty table gives no rows.
    """
    named, classes = vector_classes(rows, id_col, vector_col, label_col)
    named, classes = materialize(named, "vector-rows"), materialize(classes, "vector-classes")
    overlap, beam = OVERLAP, BEAM
    for _ in range(3):
        cells = materialize(near_vectors(classes, cosine, overlap, beam), "vector-links")
        found = cells.groupBy("node").agg(F.sum("links").alias("links"))
        if audit_recall(classes, found, cosine) >= LEAST_RECALL:
            break
        overlap, beam = overlap + 2, beam * 2
    else:
        cells = materialize(all_near_vectors(classes, cosine), "all-vector-links")
        found = cells.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(cells.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    named_classes = (
        classes.drop("vec", "label").join(found, "node", "left")
        .join(roots, "node", "left")
        .select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    return named.join(named_classes, ["c1", "c2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"),
    )
