"""Small column functions that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` held between two bounds; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def number(c: Column | str, default: float) -> Column:
    """The number that ``c`` reads as, else ``default``; NaN counts as missing."""
    d = col(c).try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), d).otherwise(F.lit(default))


def likert(response: Column | str, direction: Column | str) -> Column:
    """A 1..5 answer as 0..1, reversed for direction -1; other answers are null."""
    r = col(response).cast("double")
    up = (r - 1) / 4
    return F.when(r.between(1, 5), F.when(col(direction) == -1, 1 - up).otherwise(up))


def band(c: Column | str) -> Column:
    """low up to 0.34, high from 0.66, else mid."""
    return F.when(col(c) <= 0.34, "low").when(col(c) >= 0.66, "high").when(col(c).isNotNull(), "mid")


def cell(c: Column | str, buckets: int) -> Column:
    """Grid step of a value in 0..1; values outside go to the outer steps, a missing one counts as 0.5."""
    v = F.coalesce(col(c), F.lit(0.5))
    return F.least(F.greatest(F.floor(v * buckets), F.lit(0)), F.lit(buckets - 1)).cast("bigint")


def any_word(text: Column | str, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the lower-cased text holds one of the terms anywhere, also inside a word."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def tokens(text: Column | str) -> Column:
    """Distinct words of three or more letters, lower-cased; apostrophes, hyphens and underscores may follow the first letter."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[a-zA-Z][a-zA-Z_'\-]{2,}"), F.lit(0)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two arrays of distinct values; two empty ones are alike, an empty and a filled one aren't."""
    n, m, both = F.size(col(a)), F.size(col(b)), F.size(F.array_intersect(col(a), col(b)))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).otherwise(F.try_divide(both.cast("double"), n + m - both))


def percent_delta(value: Column | str, base: Column | str) -> Column:
    """Relative change in percent, null for a base of practically zero."""
    return F.when(F.abs(col(base)) >= 1e-12, (col(value) - col(base)) / F.abs(col(base)) * 100)


def shorten(text: Column | str, limit: int) -> Column:
    """The text, cut to ``limit`` characters with an ellipsis if it is longer."""
    return F.when(F.length(col(text)) > limit, F.concat(F.substring(col(text), 1, limit), F.lit("…"))).otherwise(col(text))


def squeeze(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def smart_trim(text: Column | str, limit: int) -> Column:
    """A text of at most ``limit`` characters that ends with a sentence where that keeps 60 % of it, then an ellipsis.

    The last boundary among the first ``limit - 1`` characters counts: a stop, mark or semicolon before a blank, or a
    full-width one anywhere.
    """
    t = col(text)
    head = F.substring(t, 1, max(0, limit - 1))
    at = F.regexp_extract(head, r"(?s)^(.*(?:[.!?;](?= )|[。！？；]))", 1)
    whole = F.rtrim(at)
    cut = F.regexp_replace(head, r"[ ,;:，；：]+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.when(F.length(at) - 1 >= int(limit * 0.6), whole).otherwise(cut), F.lit("…")))


def weighted(coefficients: dict[str, float], source, constant: float = 0.0) -> Column:
    """``constant`` plus the weighted sum of named values; ``~name`` stands for one minus the value."""
    out = F.lit(constant)
    for name, weight in coefficients.items():
        v = 1.0 - source(name[1:]) if name.startswith("~") else source(name)
        out = out + F.lit(weight) * v
    return out


def pick(options: list[str] | tuple[str, ...], index: Column | str) -> Column:
    """The options in turn, for indexes from 1."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(col(index) - 1, F.lit(len(options))) + 1).cast("int"))


def lookup(table: dict[str, float], key: Column | str, default: float) -> Column:
    """The entry of a small fixed table."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col(key) == k, F.lit(v)).otherwise(out)
    return out


def missing_to(c: Column | str, default: float = 0.5) -> Column:
    """``c``, or ``default`` where it is null or NaN."""
    return F.when(col(c).isNull() | F.isnan(col(c)), F.lit(default)).otherwise(col(c))
