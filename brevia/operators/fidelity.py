"""Fidelity: how many of a text's telling tokens another text keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOLDED, is_blank, let, once, text_of

#: What counts as telling: numbers, identifiers, capitalised words, signal words.
TELLING = [
    r"(?U)(\b\d[\d.,_]*\b)",
    r"(?U)(\b(?:[A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]+|[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)+|[A-Za-z0-9]+-[A-Za-z0-9-]+)\b)",
    r"(?U)(\b[A-Z][a-zA-Z0-9]{2,}\b)",
    r"(?iU)(\b(?:error|fatal|critical|exception|fail(?:ed|ure)?|warn(?:ing)?|must|never|always|because|return|raises?)\b)",
]

#: What a match of each begins with, looked for first: borders of words are dear to tell.
AHEAD = [
    r"(?=\p{Nd})",
    r"(?=[A-Za-z0-9])(?<![A-Za-z0-9_])(?=[A-Za-z0-9]++[_.-]|[a-z]++[A-Z])",
    r"(?=[A-Z])(?<![A-Za-z0-9_])",
    r"(?=[EFCWMNABRefcwmnabr])(?<![A-Za-z0-9_])",
]
#: What a text with identifiers and one with signal words (lower-cased) must hold.
JOINT = r"(?=[A-Z_.-])(?:[_.-](?<=[A-Za-z0-9][_.-])[A-Za-z0-9_-]|[A-Z](?<=[a-z][A-Z]))"
HINTS = ("error", "fatal", "critical", "exception", "fail", "warn", "must", "never", "always", "because", "return", "raise")


def telling_tokens(c: Column) -> Column:
    """All matches, lower-cased; what two patterns find counts twice."""
    t = text_of(c)
    hinted = let(F.lower(t), lambda low: reduce(lambda a, b: a | b, [low.contains(h) for h in HINTS] + [t.contains(x) for x in FOLDED]))
    maybe = [F.lit(True), t.rlike(JOINT), F.lit(True), hinted]
    none = F.array().cast("array<string>")
    found = [F.when(m, F.regexp_extract_all(t, F.lit(ahead + p), F.lit(1))).otherwise(none) for m, ahead, p in zip(maybe, AHEAD, TELLING, strict=True)]
    return F.transform(F.concat(*found), F.lower)


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n)."""
    return df.select(key, F.explode(telling_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def kept_share(original: Column, compacted: Column) -> Column:
    """The share of the original's telling tokens that another text keeps, repeats counted; null if it has none.

    Tokens of both are sorted together, the other text's first: each of the original's takes one of those left of its like.
    """
    side = lambda tokens, o: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(o).alias("o")))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc.t == x.t, acc.left).otherwise(0)
        hit = ((x.o == 1) & (left > 0)).cast("int")
        return F.struct(x.t.alias("t"), F.when(x.o == 0, left + 1).otherwise(left - hit).alias("left"), (acc.kept + hit).alias("kept"))

    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("kept"))
    count = lambda a: F.aggregate(F.sort_array(F.concat(side(telling_tokens(compacted), 0), side(a, 1))), start, step, lambda acc: acc.kept)
    return let(telling_tokens(original), lambda a: F.when(F.size(a) > 0, count(a) / F.size(a)))


def fidelity(df: DataFrame, key: str, original: str, compacted: str, out: str = "fidelity") -> DataFrame:
    """df with the share of the original's telling tokens that the compacted text keeps, row by row, without a shuffle."""
    a, b = text_of(F.col(original)), text_of(F.col(compacted))
    none = F.when(is_blank(b), 0.0).otherwise(1.0)
    same = (a == b) & ~is_blank(b)
    return df.withColumn(out, once(F.when(same, 1.0).otherwise(F.coalesce(kept_share(a, b), none))))


def gate(kind: Column, original: Column, compacted: Column, share: Column, threshold: float) -> Column:
    """Whether a text goes back to its original: prose or a table that changed and kept too little."""
    if threshold <= 0:
        return F.lit(False)
    return kind.isin("text", "table") & (compacted != original) & (share < F.lit(float(threshold)))
