"""Benchmark decontamination: item-sized windows compared by SimHash, verified exactly.

A benchmark item of n words is held against every window of n words that could match it.
Windows are fingerprinted over their word shingles (64-bit SimHash); a multi-index over ten
blocks of the fingerprint finds all items within ``RADIUS`` bits: of at most 19 differing
bits over ten blocks, one block has at most one. Pairs found are verified by the weighted
similarity of their shingles, each weighed by how often it occurs.

Only windows that share a shingle with some item of their size are fingerprinted; others
have similarity zero. Everything is column expressions: one pass over the texts, in which
the shingles of the benchmark are looked up, then work on what was hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import row_key, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
RADIUS = 2 * len(BLOCKS) - 1
#: Words are runs of letters and digits, lower-cased; what stands between them does not count.
WORDS = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _shingles(words: str, width: int) -> Column:
    """Hashes of the ``width`` words from each word on; none for fewer words."""
    words = F.col(words)
    # words are fetched by place: a slice would copy the whole array for each of them
    return F.when(
        F.size(words) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(shingles: str) -> Column:
    """A bit is set if it is set in over half of the shingles."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft("
        f"if(2 * size(filter({shingles}, h -> getbit(h, b) = 1)) > size({shingles}), 1L, 0L), b))"
    )


def _blocks(fp: Column) -> list[Column]:
    out, shift = [], 0
    for bits in BLOCKS:
        out.append(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1)))
        shift += bits
    return out


def _counted(shingles: str) -> str:
    """Shingles made distinct: the n-th occurrence of one is another element."""
    return (
        f"if(size(array_distinct({shingles})) = size({shingles}), {shingles}, "
        f"transform({shingles}, (h, i) -> xxhash64(h, size(filter(slice({shingles}, 1, i), x -> x = h)))))"
    )


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n_words, shingles and fp of each item with words; repeated rows once."""
    words = benchmark.select(F.col(id_col).alias("item_id"), _words(text_or_empty(text_col)).alias("words")).distinct()
    # hashing skips words that are not there, so a short item is one shingle of all its words
    whole = F.array(F.xxhash64(*[F.get("words", F.lit(j)) for j in range(SHINGLE)]))
    sized = words.filter(F.size("words") > 0).select(
        "item_id", F.size("words").alias("n_words"),
        F.when(F.size("words") < SHINGLE, whole).otherwise(_shingles("words", SHINGLE)).alias("shingles"),
    )
    return sized.withColumn("fp", _fingerprint("shingles"))


def _windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, n_words, start, shingles of each window that shares a shingle with an item of its size.

    What is joined with the benchmark's shingles is a row's key, a place and a shingle; the
    shingles of whole texts are made again for the texts that were hit, and joined by the key.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text"),
    )
    known = materialize(items.select(F.explode("shingles").alias("known"), "n_words").distinct(), "benchmark-shingles")
    # at most SHINGLE different widths: shorter items have one shingle of all their words
    widths = [r[0] for r in items.select(F.least("n_words", F.lit(SHINGLE))).distinct().collect()]
    parts = []
    for width in sorted(widths):
        mine = known.filter(F.least("n_words", F.lit(SHINGLE)) == width)
        worded = narrow.select("row_key", _words(F.col("text")).alias("words"))
        hashed = worded.select("row_key", _shingles("words", width).alias("all"))
        # outer: for an inner explode Spark adds a filter on the array's size, below which the words
        # would be found again for each shingle; the join drops the nulls
        placed = hashed.select("row_key", F.posexplode_outer("all").alias("pos", "known"))
        hits = materialize(placed.join(mine, "known").select("row_key", "pos", "n_words").distinct(), "shingle-hits")
        # hits grow with the documents, so they are not to be broadcast however few they are
        hit_keys = hits.select("row_key").distinct().hint("merge")
        texts = narrow.join(hit_keys, "row_key", "left_semi").dropDuplicates(["row_key"])
        whole = texts.select("doc_id", "row_key", _words(F.col("text")).alias("words")).select(
            "doc_id", "row_key", _shingles("words", width).alias("all")
        )
        hits = hits.hint("merge").join(whole, "row_key")
        m = F.col("n_words") - width + 1
        low = F.greatest(F.lit(0), F.col("pos") - m + 1)
        # a text shorter than the item is one window
        high = F.greatest(F.lit(0), F.least(F.col("pos"), F.size("all") - m))
        parts.append(
            hits.select("doc_id", "row_key", "n_words", "pos", m.alias("m"), low.alias("low"), high.alias("high"),
                        F.slice("all", low + 1, high - low + m).alias("near"))
        )
    hit = parts[0]
    for p in parts[1:]:
        hit = hit.unionByName(p)
    # a window belongs to the first hit in it, so each is made once
    order = Window.partitionBy("row_key", "n_words").orderBy("pos")
    before = F.coalesce(F.lag("pos").over(order) + 1, F.lit(0))
    first = hit.withColumn("first", F.greatest("low", before)).filter("first <= high")
    starts = F.transform(
        F.sequence("first", "high"),
        lambda s: F.struct(s.alias("start"), F.slice("near", s - F.col("low") + 1, F.col("m")).alias("shingles")),
    )
    return first.select("doc_id", "row_key", "n_words", F.explode_outer(starts).alias("w")).select(
        "doc_id", "row_key", "n_words", "w.start", "w.shingles"
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, row_key, item_id, start (word), n_words, distance and similarity of each row's best window per item.

    Null and empty texts and items match nothing. An item of fewer than five words is one
    shingle of all of them. A text shorter than an item is compared whole. Rows equal in id
    and text give one result; of windows equally similar the first counts. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    if not items.take(1):
        schema = "doc_id {0}, row_key long, item_id {1}, start int, n_words int, distance int, similarity double"
        return spark.createDataFrame(
            [], schema.format(docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
        )
    windows = _windows(docs, items, id_col, text_col).withColumn("fp", _fingerprint("shingles"))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_blocks(F.col("fp")))])
    probes = [
        F.struct(F.lit(i).alias("block"), v.bitwiseXOR(F.lit(flip)).alias("value"))
        for i, v in enumerate(_blocks(F.col("fp")))
        for flip in [0, *[1 << b for b in range(BLOCKS[i])]]
    ]
    index = materialize(
        items.select("item_id", F.col("n_words").alias("size"), F.col("fp").alias("item_fp"), F.explode(F.array(*probes)).alias("p"))
        .select("item_id", "size", "item_fp", "p.block", "p.value"),
        "benchmark-index",
    )
    keyed = windows.select("*", F.explode(blocks).alias("b")).select(
        "doc_id", "row_key", "n_words", "start", "shingles", "fp", F.col("b.block").alias("_block"), F.col("b.value").alias("_value")
    )
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = keyed.join(
        index,
        (F.col("n_words") == F.col("size")) & (F.col("_block") == F.col("block")) & (F.col("_value") == F.col("value"))
        & (distance <= RADIUS),
    ).select("doc_id", "row_key", "item_id", "start", "n_words", distance.alias("distance"), "shingles")
    texts = items.select(F.col("item_id").alias("_item"), F.col("n_words").alias("_size"), F.col("shingles").alias("wanted"))
    both = near.join(texts, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("n_words") == F.col("_size")))
    shared = F.expr(f"size(array_intersect({_counted('shingles')}, {_counted('wanted')}))")
    alike = shared / (F.size("shingles") + F.size("wanted") - shared)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance"))
    return (
        both.withColumn("similarity", alike)
        .filter(F.col("similarity") >= similarity)
        .groupBy("doc_id", "row_key", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id", "row_key", "item_id", (-F.col("best.back")).alias("start"),
            F.col("best.n_words").alias("n_words"), F.col("best.distance").alias("distance"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged."""
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col).select("row_key").distinct()
    found = materialize(found, "contaminated")
    key = row_key(id_col, text_col)
    kept = docs.select(F.struct("*").alias("row"), key.alias("row_key")).join(found, "row_key", "left_anti")
    return kept.select("row.*")
