"""Column expressions: all built-in, so they stay inside whole-stage codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CATEGORIES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_hash(key: Column | str, buckets: int, salt: str = "") -> Column:
    """A bucket in ``0 … buckets-1`` that a retried task computes again the same."""
    text = F.concat(F.lit(salt), col(key).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_score(key: Column | str, salt: str = "") -> Column:
    """A percentile score, 0 … 100 inclusive."""
    return stable_hash(key, 101, salt)


def pick_category(
    key: Column | str,
    n_categories: int = len(CATEGORIES),
    categories: Sequence[str] = CATEGORIES,
    salt: str = "",
) -> Column:
    """One of the first ``n_categories`` names, chosen by a hash of ``key``."""
    names = F.array(*[F.lit(c.strip()) for c in categories])
    return F.element_at(names, (stable_hash(key, n_categories, salt) + 1).cast("int"))


def padded(c: Column | str, width: int) -> Column:
    """Zeros in front up to ``width``; a longer text stays as it is."""
    text = col(c).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def masked(width: int) -> Column:
    """A mask of fixed width; missing inputs are masked too."""
    return F.lit("*" * width)


def mask_tail(c: Column | str, n: int) -> Column:
    """Hide the last ``n`` characters; a shorter text becomes ``n`` stars."""
    kept = F.greatest(F.length(col(c)) - F.lit(n), F.lit(0))
    return F.concat(F.left(col(c), kept), F.lit("*" * n))


def one_line(c: Column | str) -> Column:
    """Line feeds and carriage returns become spaces."""
    return F.translate(col(c), "\n\r", "  ")


def to_percentile(c: Column | str) -> Column:
    """Numeric coercion: text that is no number becomes null."""
    return col(c).try_cast("bigint")


def round_amount(c: Column | str) -> Column:
    return F.round(col(c), 2)


def parse_iso_ampm(c: Column | str) -> Column:
    """Parse an ISO timestamp with offset that may end in ``AM`` or ``PM``.

    The twelve-hour rules are the usual ones: 12 AM is midnight, 12 PM is noon.
    Text that does not parse becomes null.
    """
    text = col(c)
    bare = F.regexp_replace(text, " ([AP]M)$", "")
    with_colon = F.regexp_replace(bare, r"([+-]\d{2})(\d{2})$", "$1:$2")
    parsed = with_colon.try_cast("timestamp")
    clock_hour = F.substring(bare, 12, 2).try_cast("int")
    shift = (
        F.when(text.endswith(" PM") & (clock_hour < 12), 12)
        .when(text.endswith(" AM") & (clock_hour == 12), -12)
        .otherwise(0)
    )
    return parsed + F.make_dt_interval(hours=shift)


def format_millis(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch milliseconds as text in the session's time zone."""
    return F.date_format(F.timestamp_millis(col(c)), pattern)


def format_clock(c: Column | str) -> Column:
    return format_millis(c, "HH:mm:ss")


def lag_seconds(millis: Column | str) -> Column:
    return col(millis).cast("double") / 1000


def published_count(max_offset: Column | str) -> Column:
    """Offsets start at 0, so the count is the largest offset plus one."""
    return col(max_offset) + 1


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Small Latin letters with a decomposition, and their base letters; strokes and ligatures stay."""
    letters = [chr(code) for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(code).islower()]
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in letters]
    pairs = [(c, base) for c, base in pairs if base != c and base.isascii()]
    pairs.append(("đ", "d"))
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def fold_name(c: Column | str) -> Column:
    """Lower case, trimmed, accents removed, combining ones too: the form in which names are compared."""
    accented, plain = _accent_table()
    letters = F.translate(F.lower(F.trim(col(c))), accented, plain)
    return F.regexp_replace(letters, r"\p{M}", "")
