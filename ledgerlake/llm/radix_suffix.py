"""Repeated passages by a depth-limited radix sort of sampled suffixes.

A byte goes if it lies in a string of ``DEPTH`` bytes that also starts in a document with a
smaller id. Suffixes are compared through ``DEPTH`` bytes only, most significant digit first.

Not every suffix is sorted: of the ``DEPTH - DIGIT + 1`` suffixes that start in a window, the
one whose first ``DIGIT`` bytes hash lowest (the leftmost of equals) stands for the window.
Equal windows choose equal suffixes, so no repeat is lost, and about one suffix in eighteen
is sorted at all. A suffix and the run of windows it stands for is an *anchor*.

Pass 1 puts anchors into radix buckets by their first digit (``DIGIT`` bytes, as a 64-bit hash)
and keeps those whose digit occurs in two rows or more. Pass 2 fetches the bytes around the
survivors, again to the bucket of their digit: runs that are equal as a whole share one
answer, and the windows of the others are sorted by most-significant-digit passes of eight
bytes, each within the groups that the pass before it left together. What is together at full
depth are the repeated strings. A map task sends a digit's anchors of one row, and one row per
run, so a passage that a third of all documents share costs little in each task; what else
shares it in the task is known on the spot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import row_key, text_or_empty

DEPTH = 50
DIGIT = 16
SPAN = DEPTH - DIGIT + 1
#: Where the eight-byte digits of a window begin in pass two; the last one ends with the window.
DIGITS = (*range(0, DEPTH - 8, 8), DEPTH - 8)
BATCH_BYTES = 8 << 20
#: Windows handled at once; a longer text is gone through in slices.
SLICE = 1 << 20
#: Bytes of text per radix bucket and per chunk of documents.
BUCKET_BYTES = 8 << 20
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
RUN = np.dtype([("back", "u1"), ("size", "u1"), ("holder", "u4"), ("places", "u4")])
FOUND = np.dtype([("row", "<u4"), ("left", "<u4"), ("back", "u1"), ("more", "u1")])


def digit_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the ``DIGIT`` bytes at each place."""
    v = np.frombuffer(data, np.uint8).astype(np.uint64)
    for shift in (1, 2, 4):
        v = v[:-shift] | v[shift:] << np.uint64(8 * shift)
    n = len(data) - DIGIT + 1
    h = v[:n] * MIX[0]
    h ^= h >> np.uint64(29)
    h = (h + v[DIGIT - 8 : DIGIT - 8 + n]) * MIX[1]
    h ^= h >> np.uint64(32)
    return h * MIX[2]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(digit hash, entry) of each anchor of a text; ``row`` of the entries is zero."""
    keys, entries = [np.zeros(0, np.uint64)], [np.zeros(0, FOUND)]
    for start in range(0, len(data) - DEPTH + 1, SLICE):
        h = digit_hashes(data[start : start + SLICE + DEPTH - 1])
        least, at, width = h, np.arange(len(h), dtype=np.int32), 1
        while width * 2 <= SPAN:
            first = least[:-width] <= least[width:]
            at = np.where(first, at[:-width], at[width:])
            least = np.where(first, least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            first = least[: width - SPAN] <= least[SPAN - width :]
            at = np.where(first, at[: width - SPAN], at[SPAN - width :])
        left = np.flatnonzero(np.diff(at, prepend=-1))
        right = np.append(left[1:], len(at)) - 1
        entry = np.zeros(len(left), FOUND)
        entry["left"], entry["back"], entry["more"] = left + start, at[left] - left, right - left
        # an anchor's hash is the least of many, so it is mixed again before its first bits make a bucket
        lowest = h[at[left]]
        keys.append((lowest ^ lowest >> np.uint64(32)) * MIX[0])
        entries.append(entry)
    return np.concatenate(keys), np.concatenate(entries)


def _blob(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unblob(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def _many(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, and by place in it whether it is of its key's first row, and whether the key has two rows."""
    order = np.lexsort((rows, keys))
    k, r = keys[order], rows[order]
    fresh = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    start = np.flatnonzero(fresh)
    several = np.zeros(len(start), bool)
    several[group[1:][(r[1:] != r[:-1]) & ~fresh[1:]]] = True
    if not len(k):
        return order, fresh, fresh
    return order, r == r[start][group], several[group]


def _dig(bits: int, chunks: int):
    """Pass 1, map side: anchors to radix buckets (kind 0), those shared in the batch to their chunk (kind 1)."""

    def flush(rows: list[int], found: list) -> pd.DataFrame:
        ids = np.array(rows, np.int64)
        key = np.concatenate([f[0] for f in found])
        entry = np.concatenate([f[1] for f in found])
        entry["row"] = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
        order, leading, several = _many(key, ids[entry["row"]])
        out = []
        for chunk, own in _by(ids[entry["row"][order[several]]] % chunks, order[several]):
            out.append((1 << bits | chunk, 1, chunk, ids[entry["row"][own]], None, entry[own]))
        sent = np.sort(order[leading])
        for bucket, own in _by((key[sent] >> np.uint64(64 - bits)).astype(np.int64), sent):
            used, place = np.unique(entry["row"][own], return_inverse=True)
            part = entry[own].copy()
            part["row"] = place
            out.append((bucket, 0, -1, ids[used], key[own], part))
        return pd.DataFrame(
            [(r, k, c, _blob(i), None if h is None else h.tobytes(), _blob(e)) for r, k, c, i, h, e in out],
            columns=["route", "kind", "chunk", "ids", "digits", "entries"],
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, found, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch["row_key"], batch["text"]):
                data = text.encode()
                if len(data) < DEPTH:
                    continue
                rows.append(key)
                found.append(anchors(data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield flush(rows, found)
                    rows, found, size = [], [], 0
        if rows:
            yield flush(rows, found)

    return run


def _by(keys: np.ndarray, values: np.ndarray):
    """(key, values) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
        yield int(keys[a]), values[a:b]


def _company(chunks: int):
    """Pass 1, bucket side: anchors whose digit another row has, by chunk of their row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["kind"] == 1]
        out = list(zip(known["chunk"], known["ids"], known["entries"]))
        sent = group[group["kind"] == 0]
        if len(sent):
            keys = np.concatenate([np.frombuffer(d, np.uint64) for d in sent["digits"]])
            parts = [_unblob(e, FOUND) for e in sent["entries"]]
            ids = np.concatenate([_unblob(i, np.int64)[e["row"]] for i, e in zip(sent["ids"], parts)])
            entries = np.concatenate(parts)
            order, _, several = _many(keys, ids)
            picked = order[several]
            for chunk, own in _by(ids[picked] % chunks, picked):
                out.append((chunk, _blob(ids[own]), _blob(entries[own])))
        return pd.DataFrame(out, columns=["chunk", "ids", "entries"])

    return run


def _contexts(docs: pd.DataFrame, survivors: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Pass 2, map side: the bytes of the surviving runs of a chunk's documents.

    Distinct runs go to the bucket of their digit, packed into one row per bucket, with every
    place of them in the chunk's smallest document; runs of greater documents are repeats
    already (kind 1).
    """
    columns = ["route", "kind", "runs", "entries", "docs", "row_key", "lefts"]
    if not len(survivors) or not len(docs):
        return pd.DataFrame([], columns=columns)
    ids = np.concatenate([_unblob(i, np.int64) for i in survivors["ids"]])
    entries = np.concatenate([_unblob(e, FOUND) for e in survivors["entries"]])
    places = dict(_by(ids, np.arange(len(ids))))
    runs: dict[tuple[bytes, int], dict[tuple[int, int], list[int]]] = {}
    repeats: dict[int, list[tuple[int, int]]] = {}
    docs = docs.drop_duplicates("row_key").sort_values("doc_id")
    for doc_id, key, text in zip(docs["doc_id"].tolist(), docs["row_key"].tolist(), docs["text"]):
        own = places.get(key)
        if own is None:
            continue
        data = text.encode()
        mine = entries[own]
        packed = np.unique(mine["left"].astype(np.int64) << 16 | mine["back"].astype(np.int64) << 8 | mine["more"])
        for left, back, more in zip((packed >> 16).tolist(), (packed >> 8 & 255).tolist(), (packed & 255).tolist()):
            run = data[left : left + more + DEPTH]
            holders = runs.setdefault((run, back), {})
            if holders and next(iter(holders))[0] < doc_id:
                repeats.setdefault(key, []).append((left, left + more + DEPTH))
            else:
                holders.setdefault((doc_id, key), []).append(left)
    buckets: dict[int, list] = {}
    for (run, back), holders in runs.items():
        route = xxhash.xxh64_intdigest(run[back : back + DIGIT]) >> (64 - bits)
        for holder, lefts in holders.items():
            buckets.setdefault(route, []).append((run, back, holder, lefts))
    out = []
    for route, held in buckets.items():
        place: dict[tuple[int, int], int] = {}
        entry = np.array([(back, len(run), place.setdefault(h, len(place)), len(lefts)) for run, back, h, lefts in held], RUN)
        out.append((
            route, 0, zlib.compress(b"".join(run for run, _, _, _ in held), 1), _blob(entry),
            _blob(np.array(list(place), np.int64)), 0,
            _blob(np.concatenate([np.array(lefts, np.uint32) for _, _, _, lefts in held])),
        ))
    for key, spans in repeats.items():
        out.append((1 << bits | key % 256, 1, None, None, None, key, np.array(spans, np.uint32).tobytes()))
    return pd.DataFrame(out, columns=columns)


def _held(sent: pd.DataFrame):
    """(back, run, doc_id, row_key, lefts) of every run that was sent."""
    for runs, entries, docs, lefts in zip(sent["runs"], sent["entries"], sent["docs"], sent["lefts"]):
        data, places = zlib.decompress(runs), _unblob(lefts, np.uint32)
        holders = _unblob(docs, np.int64).reshape(-1, 2).tolist()
        at = of = 0
        for back, size, holder, count in _unblob(entries, RUN).tolist():
            yield (back, data[at : at + size], *holders[holder], places[of : of + count])
            at, of = at + size, of + count


def first_holders(data: bytes, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For the window of ``DEPTH`` bytes at each start the least of ``docs`` among equal windows.

    Most-significant-digit passes: the windows of a group are sorted by their next eight bytes
    and split where these differ; a group of one window is done. The last digit overlaps the
    one before it, and what is together after it is equal through the full depth.
    """
    words = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    for shift in (1, 2, 4):
        words = words[:-shift] << np.uint64(8 * shift) | words[shift:]
    first = docs.copy()
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for place in DIGITS:
        if not len(alive):
            break
        digit = words[starts[alive] + place]
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(fresh) - 1
        several = (np.bincount(group) > 1)[group]
        alive, group = alive[several], group[several]
    if len(alive):
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(docs[alive], begin)
        first[alive] = np.repeat(least, np.diff(np.append(begin, len(alive))))
    return first


def _spans_of(hits: np.ndarray) -> list[tuple[int, int]]:
    """The bytes that the windows at these ordered places cover, as maximal runs."""
    cut = np.flatnonzero(np.diff(hits) > DEPTH)
    begins = hits[np.append(0, cut + 1)]
    ends = hits[np.append(cut, len(hits) - 1)] + DEPTH
    return list(zip(begins.tolist(), ends.tolist()))


def _windows(group: pd.DataFrame) -> pd.DataFrame:
    """Pass 2, bucket side: spans of the windows that a document with a smaller id holds."""
    known = group[group["kind"] == 1]
    out = list(zip(known["row_key"], known["lefts"]))
    rows = list(_held(group[group["kind"] == 0]))
    least: dict[tuple[bytes, int], int] = {}
    for back, run, doc_id, _, _ in rows:
        least[run, back] = min(least.get((run, back), doc_id), doc_id)
    hit: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    if len(least) > 1:
        names, docs = list(least), np.array(list(least.values()), np.int64)
        sizes = np.array([len(run) for run, _ in names], np.int64)
        begins = np.append(0, np.cumsum(sizes)[:-1])
        counts = sizes - DEPTH + 1
        of = np.repeat(np.arange(len(names)), counts)
        place = np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(counts)[:-1]), counts)
        own = docs[of]
        late = np.flatnonzero(first_holders(b"".join(run for run, _ in names), begins[of] + place, own) < own)
        for i, at in _by(of[late], place[late]):
            hit[names[i]] = _spans_of(at)
    spans: dict[int, list[tuple[int, int]]] = {}
    for back, run, doc_id, key, lefts in rows:
        mine = [(0, len(run))] if least[run, back] < doc_id else hit.get((run, back))
        if mine:
            found = spans.setdefault(key, [])
            for left in lefts.tolist():
                found.extend((left + a, left + b) for a, b in mine)
    out += [(key, np.array(s, np.uint32).tobytes()) for key, s in spans.items()]
    return pd.DataFrame(out, columns=["row_key", "spans"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk with their removed spans and what is left."""
    spans: dict[int, list] = {}
    for key, packed in zip(found["row_key"].tolist(), found["spans"]):
        spans.setdefault(key, []).append(np.frombuffer(packed, np.uint32).reshape(-1, 2))
    out = []
    for doc_id, key, text in zip(docs["doc_id"], docs["row_key"].tolist(), docs["text"]):
        data = text.encode()
        gone = _merged(map(tuple, np.unique(np.concatenate(spans[key]), axis=0).tolist())) if key in spans else []
        kept, at = [], 0
        for a, b in gone:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        out.append((
            doc_id, len(data), sum(b - a for a, b in gone), len(gone),
            hashlib.sha256(b"".join(kept)).hexdigest(), [x for s in gone for x in s],
        ))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return frame.astype({"doc_id": "Int64"})


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (flat list of byte ranges) of every row.

    A null text is empty; texts under ``DEPTH`` bytes neither lose nor remove anything. Rows
    with the same id do not remove from each other, nor do rows without an id, in either
    direction. Repeated rows get equal results; an empty table gives no rows.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text")
    )
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-total // BUCKET_BYTES))
    bits = max(2, (parts - 1).bit_length())
    usable = named.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= DEPTH))

    routed = usable.select("row_key", "text").mapInPandas(
        _dig(bits, parts), "route long, kind int, chunk long, ids binary, digits binary, entries binary"
    )
    survivors = materialize(
        routed.repartition(2 << bits, "route").groupBy("route").applyInPandas(_company(parts), "chunk long, ids binary, entries binary"),
        "suffix-survivors",
    )
    chunk = F.pmod("row_key", F.lit(parts))
    runs = (
        usable.withColumn("chunk", chunk).groupBy("chunk")
        .cogroup(survivors.groupBy("chunk"))
        .applyInPandas(
            lambda d, s: _contexts(d, s, bits),
            "route long, kind int, runs binary, entries binary, docs binary, row_key long, lefts binary",
        )
    )
    spans = materialize(
        runs.repartition(2 << bits, "route").groupBy("route").applyInPandas(_windows, "row_key long, spans binary"),
        "suffix-spans",
    )
    return (
        named.withColumn("chunk", chunk).groupBy("chunk")
        .cogroup(spans.withColumn("chunk", chunk).groupBy("chunk"))
        .applyInPandas(
            _cut,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>",
        )
    )
