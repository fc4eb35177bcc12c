"""Prose and table compaction: the sentences that carry a text's own frequent words are kept.

Each text is told by itself, in Arrow batches, so nothing is shuffled. Blanks are those of Java's expressions (ASCII alone) where
an expression names them, and str.strip()'s elsewhere.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FOLDED, let, once, text_of

#: Words that carry no content, and words that mark a sentence as telling.
STOPWORDS = (
    "the a an and or but of to in on for with is are was were be been being it this that these those as at by from into than then so "
    "if we you they he she i our your their its can will would could may might do does did not"
).split()
SIGNAL = re.compile(r"must|should|never|always|error|fail|because|therefore|note|warning|important|return|raises?", re.IGNORECASE)

_S = r"[ \t\n\x0b\f\r]"
GAP = re.compile(rf"\n{_S}*\n")
HEADING = re.compile(rf"{_S}{{0,3}}#{{1,6}}{_S}")
HEADING_LINE = re.compile(rf"^({_S}{{0,3}}#{{1,6}}{_S}.*)$", re.MULTILINE)
SENTENCE_END = re.compile(rf"(?<=[.!?]){_S}+(?=[A-Z0-9\"'(\[])")
#: Words of three letters or more.
WORD = re.compile(r"[A-Za-z][A-Za-z'-]{2,}")
_STOP = frozenset(STOPWORDS)
#: What a sentence with a telling word holds once it is lower-cased, unless it has one of the letters beyond ASCII that count as an ASCII letter.
_HINTS = SIGNAL.pattern.replace("raises?", "raise").split("|")
_NINTH = Decimal("1e-9")


def normalize(c: Column) -> Column:
    """Drops emphasis marks around text, blanks at line ends, repeated blanks, and more than one empty line."""
    # each is looked for where a text holds what it needs
    has = lambda x, *parts: reduce(lambda a, b: a | b, [x.contains(p) for p in parts])
    swap = lambda x, maybe, pattern, by: F.when(maybe, F.regexp_replace(x, pattern, by)).otherwise(x)
    out = let(text_of(c), lambda x: swap(x, has(x, "*", "_"), r"(?d)(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1", "$2"))
    out = let(out, lambda x: swap(x, has(x, " \n", "\t") | x.endswith(" "), r"(?dm)[ \t]+$", ""))
    out = let(out, lambda x: swap(x, has(x, "  ", "\t"), r"[ \t]{2,}", " "))
    return let(out, lambda x: swap(x, has(x, "\n\n\n"), r"\n{3,}", "\n\n"))


def in_word(ch: str) -> bool:
    """Whether a character belongs to words: letters, marks, digits, connectors, joiners and circled letters."""
    if ch.isascii():
        return ch.isalnum() or ch == "_"
    kind = unicodedata.category(ch)
    circled = "Ⓐ" <= ch <= "ⓩ" or "\U0001f130" <= ch <= "\U0001f149" or "\U0001f150" <= ch <= "\U0001f169" or "\U0001f170" <= ch <= "\U0001f189"
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or ch in "‌‍" or circled


def signals(sentence: str) -> bool:
    """Whether one of the telling words stands in a sentence as a word of its own."""
    for m in SIGNAL.finditer(sentence):
        a, b = m.span()
        if not (a and in_word(sentence[a - 1])) and not (b < len(sentence) and in_word(sentence[b])):
            return True
    return False


def pieces(text: str) -> list[tuple[str, bool]]:
    """(sentence, heading): a heading's block is one piece, other blocks are cut at sentence ends."""
    found = []
    for block in GAP.split(text):
        whole = block.strip()
        if not whole:
            continue
        if HEADING.match(block):
            found.append((whole, True))
        else:
            found += [(s, False) for s in map(str.strip, SENTENCE_END.split(whole)) if s]
    return found


def scores(found: list[tuple[str, bool]]) -> list[Decimal | None] | None:
    """Of each piece: how frequent its words are in the text, with more for the lead and for telling words, rounded half up to
    nine places; null for headings, and for all if no piece has content words."""
    words = [[] if heading else [w for w in map(str.lower, WORD.findall(s)) if w not in _STOP] for s, heading in found]
    tf = Counter()
    for ws in words:
        tf.update(ws)
    if not tf:
        return None
    top, out = max(tf.values()), []
    text = "\n".join(s for s, _ in found)
    every, low = any(c in text for c in FOLDED), text.lower()
    hints = [h for h in _HINTS if h in low]
    for i, ((s, heading), ws) in enumerate(zip(found, words, strict=True)):
        if not ws:
            out.append(None if heading else Decimal(0))
            continue
        base = sum(map(tf.__getitem__, ws)) / top / math.sqrt(len(ws))
        low = s.lower() if hints else ""
        telling = (every or any(h in low for h in hints)) and signals(s)
        score = base + (1.0 if i < 2 else 0.0) + (0.6 if telling else 0.0)
        out.append(Decimal(repr(score)).quantize(_NINTH, ROUND_HALF_UP))
    return out


def shortened(text: str, keep: float) -> str | None:
    """Headings, and the best share of the other pieces, earlier ones first among equals, all in their order; None without content words."""
    found = pieces(text)
    scored = scores(found)
    if scored is None:
        return None
    ranked = sorted((i for i, (_, heading) in enumerate(found) if not heading), key=lambda i: (-scored[i], i))
    best = set(ranked[: max(1, int(len(ranked) * keep))])
    out = " ".join(s for i, (s, heading) in enumerate(found) if heading or i in best)
    return (HEADING_LINE.sub(r"\n\1\n", out) if "#" in out else out).strip()


_PIECES = T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("heading", T.BooleanType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(_PIECES)
def _pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [{"sentence": s, "heading": h, "score": None} for s, h in pieces(t)])


@F.pandas_udf(_PIECES)
def _scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """No pieces of texts without content words."""

    def told(t: str) -> list[dict]:
        found = pieces(t)
        return [{"sentence": s, "heading": h, "score": None if x is None else float(x)} for (s, h), x in zip(found, scores(found) or [], strict=False)]

    for texts in batches:
        yield texts.map(told)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence, heading)."""
    rows = df.select(key, _pieces(text_of(F.col(text))).alias("_all")).select(key, F.posexplode("_all").alias("idx", "_p"))
    return rows.select(key, "idx", "_p.sentence", "_p.heading")


def scored_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence, heading, score): score is null for headings; texts without content words have no rows."""
    rows = df.select(key, _scored(text_of(F.col(text))).alias("_all")).select(key, F.posexplode("_all").alias("idx", "_p"))
    return rows.select(key, "idx", "_p.sentence", "_p.heading", "_p.score")


def compact_prose(df: DataFrame, key: str, text: str, keep: float = 0.45, normalized: bool = True, out: str = "compacted") -> DataFrame:
    """df with its texts compacted, row by row, without a shuffle; texts under 400 characters and those that don't get shorter stay (normalised)."""

    @F.pandas_udf(T.StringType())
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else shortened(t, keep))

    df = df.withColumn("_norm", once(normalize(F.col(text)) if normalized else text_of(F.col(text))))
    df = df.withColumn("_short", short(F.when(F.length("_norm") >= 400, F.col("_norm"))))
    best = F.when(F.length("_short") < F.length("_norm"), F.col("_short")).otherwise(F.col("_norm"))
    return df.withColumn(out, F.coalesce(best, "_norm")).drop("_norm", "_short")
