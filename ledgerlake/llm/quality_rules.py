"""Quality rules: a table of thresholds compiled into one projection.

Each text is measured by column expressions (words, code points, symbols, stop words, lines,
repeated three-word windows); a rule bounds one measure, or the ratio of two in hundredths, so
that all comparisons are of whole numbers. ``compiled`` turns any table of rules into the
columns of one ``select``. Nothing is shuffled, and no user function runs.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was are be by this from or "
    "der die das und ist von den dem ein eine zu mit nicht für auf im sich als auch es "
    "le la les un une et de des du en est que qui dans pour par au pas sur ne "
    "el los las una y del con por para se no su al lo como más"
).split()


class Rule(NamedTuple):
    """``least`` <= top <= ``most``, or 100 * top / bottom between them if there is a bottom."""

    name: str
    top: str
    bottom: str | None = None
    least: int | None = None
    most: int | None = None


#: What every text must meet whatever other rules are asked for.
BASE = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=50),
)
#: Limits as for web text, wide enough for prose in the four languages.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("exclamations", "n_exclamations", "n_words", most=20),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)


def _count_of(text: Column, characters: str) -> Column:
    """How many of the text's characters are among the given ones."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def measured(docs: DataFrame, text: Column, kept: list[Column]) -> DataFrame:
    """The columns of ``kept`` and every measure of each text, as longs."""
    # a projection for each step: what the next one uses often is then computed once
    cut = docs.select(*kept, text.alias("_text")).select(
        "*",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "").alias("_lines"),
        F.split(F.lower("_text"), r"[^\p{L}]+").alias("_letters"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)]).alias("h"), i.alias("at")),
    )
    none = F.array().cast("array<struct<h: bigint, at: int>>")
    ordered = cut.withColumn("_sorted", F.sort_array(F.when(F.size("_words") >= WINDOW, windows).otherwise(none)))

    def found_again(window: Column, i: Column) -> Column:
        beside = [F.get("_sorted", i + step)["h"] == window["h"] for step in (-1, 1)]
        return F.coalesce(beside[0] | beside[1], F.lit(False))

    again = F.sort_array(F.transform(F.filter("_sorted", found_again), lambda w: w["at"]))
    # each window adds the words that the one before it does not hold (least skips the null before the first)
    added = F.transform("_again", lambda at, i: F.least(F.lit(WINDOW), at - F.get("_again", i - 1)))
    measures = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.translate("_text", SPACES, "")),
        "n_symbols": _count_of(F.col("_text"), SYMBOLS),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.aggregate(added, F.lit(0).cast("long"), lambda total, n: total + n),
        "n_exclamations": _count_of(F.col("_text"), "!"),
        "n_stop_words": F.size(F.array_intersect("_letters", F.array(*[F.lit(w) for w in STOP_WORDS]))),
        "n_bullet_lines": F.size(F.filter("_lines", lambda line: F.ltrim(line, F.lit(SPACES)).rlike("^[-*•]"))),
        "n_cut_lines": F.size(F.filter("_lines", lambda line: F.rtrim(line, F.lit(SPACES)).rlike("(\\.\\.\\.|…)$"))),
    }
    names = [c for c in cut.columns if c not in ("_text", "_words", "_lines", "_letters")]
    # a generator, as filters on the measures are then not moved into the projections below it, where
    # the arrays would be made again for every use
    row = F.struct(*[m.cast("long").alias(n) for n, m in measures.items()])
    return ordered.withColumn("_again", again).select(*names, F.inline(F.array(row)))


def broken(rule: Rule) -> Column:
    """Whether a text's measures break the rule."""
    value = F.col(rule.top) if rule.bottom is None else F.lit(100) * F.col(rule.top)
    unit = F.lit(1) if rule.bottom is None else F.col(rule.bottom)
    tests = [value < unit * F.lit(rule.least)] if rule.least is not None else []
    tests += [value > unit * F.lit(rule.most)] if rule.most is not None else []
    return reduce(Column.__or__, tests, F.lit(False))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a text breaks, in the table's order."""
    return F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]).cast("array<string>"))


def quality_report(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, the measures, base_failed, broken (names of all broken rules) and kept of every row.

    A null text has no words. A window of three words is known by 64 bits of hash within its
    text. Repeated rows are reported each, ids play no part, an empty table gives no rows.
    A text must fit into a task's memory with an array of its words.
    """
    marked = measured(docs, text_or_empty(text_col), [F.col(id_col).alias("doc_id")])
    base_failed = reduce(Column.__or__, [broken(r) for r in BASE])
    return marked.withColumns({"base_failed": base_failed, "broken": compiled((*BASE, *rules))}).withColumn(
        "kept", F.size("broken") == 0
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, columns unchanged; null and empty texts go."""
    marked = measured(docs, text_or_empty(text_col), [F.struct("*").alias("_row")])
    return marked.filter(F.size(compiled((*BASE, *rules))) == 0).select("_row.*")
