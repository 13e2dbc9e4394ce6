"""Secret scan: known token shapes, and unknown ones by sliding-window entropy.

Everything is a column expression over one row, so the scan is one pass without a shuffle.
Positions come from the pieces between the matches of a pattern. Candidate strings (long
runs of token characters) are walked once, in blocks: a window of fixed width slides over
them, each step changes the counts of the character that leaves and of the one that enters,
and with them the window's sum of ``n log2 n``. The hull of the windows whose entropy passes
the threshold of the candidate's character class is a finding, unless the allow-list knows it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The shapes of known tokens, in the order that sorts findings at one place.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Character classes in the order they are tried, with the least entropy in bits of a secret's
#: window. Between prose and random strings: the most that a long word or path of the test
#: corpus reaches is 3.59 (letters), and 95 % of random strings of 32 characters reach 2.88
#: (digits), 3.28 (hex) and 3.61 (letters).
CLASSES = (
    ("digits", r"^[0-9]+$", 2.75),
    ("hex", r"^[0-9A-Fa-f]+$", 2.95),
    ("letters", r"^(?:[a-z/_-]++|[A-Z/_-]++|[A-Z]?[a-z]++(?:[/_-][A-Z]?[a-z]++)*+)$", 3.65),
    ("mixed", r"[0-9]", 3.65),
    ("cased", r"", 3.95),
)
#: Candidates that are known not to be secrets: UUIDs, published digests.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(md5|sha1|sha256|sha384|sha512)-",
)
#: The parts of a candidate between its delimiters that hold one of these words end it there.
PLACEHOLDERS = ("example", "placeholder", "changeme", "dummy", "sample")
PLACEHOLDER = rf"(?i)(?<![a-z0-9+])[a-z0-9+]*?(?:{'|'.join(PLACEHOLDERS)})[a-z0-9+]*+"
#: Candidates are walked in blocks of so many window starts, as a place in a string is found by
#: walking to it.
BLOCK = 256

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _empty() -> Column:
    return F.array().cast(SPAN)


def _located(text: Column, pattern: str, rank: int, keep) -> Column:
    """Spans of the matches that ``keep(match, second group)`` accepts, in code points."""
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if rank == 0 else 0))
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(groups)).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        groups.alias("group"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), _empty().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = (begin + F.length(x["match"])).cast("long")
        span = F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        spans = F.when(keep(x["match"], x["group"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def _weight(n: int) -> float:
    return n * math.log2(n) if n > 1 else 0.0


def _steps_of_count() -> tuple[Column, Column]:
    """What the sum of ``n log2 n`` gains when the n-th character of a kind enters, and loses when it leaves."""
    gains = [_weight(n + 1) - _weight(n) for n in range(WINDOW + 1)]
    return F.array(*[F.lit(g) for g in gains]), F.array(*[F.lit(x) for x in [0.0, *gains[:-1]]])


def _occurs(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def _threshold(candidate: Column) -> Column:
    value = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        value = F.when(candidate.rlike(pattern) if pattern else F.lit(True), F.lit(least).cast("double")).otherwise(value)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(~allowed, value)


def _block_hull(block: Column, least: Column) -> Column:
    """First start and last end (null if none) of a short string's windows with entropy ``least`` or more."""
    none = F.lit(None).cast("long")
    state = F.struct(F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
    gains, losses = _steps_of_count()

    def change(at: Column) -> Column:
        # ``at`` is the 1-based place of the character that enters; the window before it ends at at - 1
        full = at > WINDOW
        before = F.substring(block, F.greatest(at - WINDOW, F.lit(1)), F.least(at - 1, F.lit(WINDOW)))
        inner = F.substring(block, F.greatest(at - WINDOW + 1, F.lit(1)), F.least(at - 1, F.lit(WINDOW - 1)))
        left = F.when(full, _occurs(before, F.substring(block, at - WINDOW, F.lit(1)))).otherwise(F.lit(0))
        entered = _occurs(inner, F.substring(block, at, F.lit(1)))
        return F.struct(at.alias("at"), (F.get(gains, entered) - F.get(losses, left)).alias("change"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["change"]
        high = (x["at"] >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= least)
        return F.struct(
            total.alias("sum"),
            F.when(acc["first"].isNull() & high, (x["at"] - WINDOW).cast("long")).otherwise(acc["first"]).alias("first"),
            F.when(high, x["at"].cast("long")).otherwise(acc["last"]).alias("last"),
        )

    # the changes are an array of their own, as a value that is used twice in a walk is made twice
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(block)), change), state, step)


def window_hull(candidate: Column, least: Column) -> Column:
    """First start and last end (both relative, null if none) of windows with entropy ``least`` or more.

    A block is continued by the beginning of the next, so that every window lies in one.
    """
    blocks = F.regexp_extract_all(candidate, F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
    ends = F.transform(blocks, lambda b: F.substring(b, F.lit(1), F.lit(WINDOW - 1)))
    # the blocks without the first, and nothing after the last: each beside its block
    beside = F.arrays_zip(
        blocks.alias("block"), F.concat(F.slice(ends, 2, F.size(ends)), F.array(F.lit(""))).alias("more")
    )
    none = F.lit(None).cast("long")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("first"), none.alias("last"))

    def step(acc: Column, b: Column) -> Column:
        hull = F.transform(F.array(F.concat(b["block"], b["more"])), lambda x: _block_hull(x, least))
        return F.aggregate(
            hull, acc,
            lambda s, h: F.struct(
                (s["at"] + BLOCK).cast("long").alias("at"),
                F.coalesce(s["first"], s["at"] + h["first"]).alias("first"),
                F.coalesce(s["at"] + h["last"], s["last"]).alias("last"),
            ),
        )

    return F.aggregate(beside, state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _without_placeholders(text: Column) -> Column:
    """The text with blanks for the characters of placeholders, so that places stay."""
    found = F.arrays_zip(
        F.split(text, PLACEHOLDER, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)).alias("match"),
    )
    blank = F.transform(
        found, lambda x: F.concat(x["piece"], F.repeat(F.lit(" "), F.coalesce(F.length(x["match"]), F.lit(0))))
    )
    return F.when(text.rlike("(?i)" + "|".join(PLACEHOLDERS)), F.array_join(blank, "")).otherwise(text)


def _suspects(text: Column) -> Column:
    """Entropy spans of a text's candidate strings."""
    found = F.arrays_zip(
        F.split(text, CANDIDATE, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("match"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), _empty().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        hull = F.when(x["least"].isNotNull(), window_hull(x["match"], x["least"]))
        found_at = F.array(
            F.struct(begin.cast("long").alias("start"), F.lit(3).alias("rank"), hull.alias("hull"))
        )
        spans = F.filter(
            F.transform(
                found_at,
                lambda s: F.struct(
                    (s["start"] + s["hull"]["first"]).cast("long").alias("start"),
                    s["rank"].alias("rank"),
                    (s["start"] + s["hull"]["last"]).cast("long").alias("end"),
                ),
            ),
            lambda s: s["start"].isNotNull(),
        )
        end = (begin + F.coalesce(F.length(x["match"]), F.lit(0))).cast("long")
        return F.struct(end.alias("at"), F.concat(acc["spans"], spans).alias("spans"))

    # an array of its own: a threshold that stood in the walk would be found again at each character
    judged = F.transform(
        F.filter(found, lambda x: x["match"].isNotNull()),
        lambda x: F.struct(x["piece"].alias("piece"), x["match"].alias("match"), _threshold(x["match"]).alias("least")),
    )
    return F.aggregate(judged, start, step, lambda acc: acc["spans"])


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the known shapes, base_spans, all spans (structs) of every row.

    A null or empty text has no findings. Spans are code points, end exclusive. Base findings
    always stay; an entropy finding that lies within one of them is not listed again.
    Repeated rows are scanned each for itself; an empty table gives no rows.
    """
    text = F.col("text")
    lowered = F.lower(text)
    names = F.lit(False)
    for word in KEYWORDS:
        names = names | lowered.contains(word)
    assigned = _located(text, ASSIGN, 0, lambda m, g: F.length(g) >= LEAST_ASSIGNED)
    access = _located(text, ACCESS, 1, lambda m, g: F.length(m) >= LEAST_ACCESS)
    # a run of hex digits is one match, so asking for the length at once finds the same runs
    digits = _located(text, HEX.replace("+", f"{{{LEAST_HEX},}}"), 2, lambda m, g: F.length(m) >= LEAST_HEX)
    scanned = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id",
        F.when(names, assigned).otherwise(_empty()).alias("assign"),
        F.when(text.contains("AKIA"), access).otherwise(_empty()).alias("access"),
        F.when(text.rlike(f"[0-9a-f]{{{LEAST_HEX}}}"), digits).otherwise(_empty()).alias("hex"),
        _without_placeholders(text).alias("plain"),
    )
    plain = F.col("plain")
    based = scanned.withColumn("suspects", F.when(plain.rlike(CANDIDATE), _suspects(plain)).otherwise(_empty())).withColumn("base_spans", F.array_sort(F.concat("assign", "access", "hex")))
    fresh = F.filter(
        "suspects",
        lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
    )
    return based.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        "base_spans",
        F.array_sort(F.concat("base_spans", fresh)).alias("spans"),
    )


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings as text: a digest of the base spans and a list of all spans."""
    return find_secrets(docs, id_col, text_col).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.encode(_written(F.col("base_spans")), "utf-8"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
