"""Content routing: which kind of payload a text is."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANK, is_blank, let, lines, strip, text_of

KINDS = ("json", "code", "log", "diff", "table", "text")

#: Lines looked at, and how lines of each kind begin.
LOG_SAMPLE, TABLE_SAMPLE = 200, 60
DIFF_NEEDLES = ("diff --git", "@@ ", "+++ ", "--- ", "index ")
DIFF_LINE = r"(?dm)^(?:diff --git|@@ |\+\+\+ |--- |index [0-9a-f]+)"
CODE_LINE = (
    r"(?dmU)^\s*(?:def |class |import |from \w+ import |func |package |public |private |const |let |var |#include|fn |impl |export |async def )"
)
LOG_LINE = (
    r"(?iU)^\s*(?:\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}:\d{2}|\[\d{2}:\d{2}:\d{2}\]|(?:trace|debug|info|warn|warning|error|fatal|critical)\b"
    r"|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
)


def parses(text: str) -> bool:
    """Whether a stripped text is JSON, or its first line alone is an array or an object (JSON lines, cut-off output)."""
    try:
        json.loads(text)
        return True
    except (ValueError, RecursionError):
        head = text.splitlines()[0].strip()
    try:
        return head[:1] in ("[", "{") and json.loads(head) is not None
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def _parses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else parses(t))


def looks_like_json(text: Column) -> Column:
    """The worker sees only texts that open with a bracket; others are null to it."""
    t = text_of(text)
    return F.coalesce(_parses(F.when(t.rlike(rf"\A[{BLANK}]*[\[{{]"), strip(t))), F.lit(False))


def _sample(text: Column, n: int) -> Column:
    return F.slice(F.filter(lines(text_of(text)), lambda x: ~is_blank(x)), 1, n)


def _log_share(s: Column) -> Column:
    return F.when(F.size(s) == 0, 0.0).otherwise(F.size(F.filter(s, lambda x: x.rlike(LOG_LINE))) / F.size(s))


def log_line_ratio(text: Column, sample: int = LOG_SAMPLE) -> Column:
    """Share of the first lines, blank ones aside, that begin like a log's."""
    return let(_sample(text, sample), _log_share)


def _table_share(s: Column) -> Column:
    marked = lambda mark: F.size(F.filter(s, lambda x: F.substring_index(x, mark, 2) != x))
    return F.when(F.size(s) < 3, 0.0).otherwise(F.greatest(marked("|"), marked(",")) / F.size(s))


def table_ratio(text: Column, sample: int = TABLE_SAMPLE) -> Column:
    """Share of the first lines with two bars, or two commas, whichever is more; 0 for under three lines."""
    return let(_sample(text, sample), _table_share)


def detect(text: Column) -> Column:
    """The kind of each text; its lines are cut once for logs and tables, and searched for diffs only if they hold such a line's words."""
    t = text_of(text)
    maybe = reduce(lambda a, b: a | b, [t.contains(n) for n in DIFF_NEEDLES])
    by_lines = lambda s: (
        F.when(_log_share(s) >= 0.4, "log").when(t.rlike(CODE_LINE), "code").when(_table_share(F.slice(s, 1, TABLE_SAMPLE)) >= 0.6, "table").otherwise("text")
    )
    return (
        F.when(is_blank(t), "text")
        .when(maybe & t.rlike(DIFF_LINE), "diff")
        .when(looks_like_json(t), "json")
        .otherwise(let(_sample(t, LOG_SAMPLE), by_lines))
    )
