"""Text primitives as column expressions, with the same meaning for every Unicode text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as str.strip() sees them, for use inside a character class.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OTHER_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"

#: Letters beyond ASCII that count as an ASCII letter where an expression passes over case; lower-casing leaves some of them.
FOLDED = ("\u017f", "\u212a", "\u0130", "\u0131")


def text_of(c: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{BLANK}]")


def lines(c: Column) -> Column:
    """Lines without their ends; a last end opens no line, and an empty text has none."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    # a single character is cut at without an expression
    parts = F.when(c.rlike(OTHER_END), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(let(parts, whole))


def words(c: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}+)"), F.lit(1))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once a row however often fn uses it: a lambda's variable is never computed again."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def once(value: Column) -> Column:
    """The value as a generator of one row, which the optimizer neither copies into what reads it nor pushes filters through."""
    return F.explode(F.array(value))


def shingles(tokens: Column, k: int = 3) -> Column:
    """Runs of k words, repeats included; fewer words give one shingle, none give none."""

    def runs(t: Column) -> Column:
        n = F.size(t) - (k - 1)
        parts = [F.slice(t, F.lit(i), n) for i in range(1, k + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, lambda a, b: F.concat(a, F.lit(" "), b))
        short = F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(t, " ")))
        return F.when(F.size(t) >= k, out).otherwise(short)

    return let(tokens, runs)


def jaccard(a: Column, b: Column, k: int = 3) -> Column:
    """Share of common distinct shingles; 1 if both have none, 0 if one has none."""

    def share(p: Column) -> Column:
        x, y = p.x, p.y
        both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both)

    sets = [F.array_distinct(shingles(words(c), k)) for c in (a, b)]
    return let(F.struct(sets[0].alias("x"), sets[1].alias("y")), share)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
