"""Token estimates and prices."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANK, WORD, text_of

#: Input price in USD per million tokens, by tier, and that of any other model.
PRICES = {"economy": 0.30, "standard": 3.00, "premium": 15.00}
DEFAULT_PRICE = 2.50


def token_units(c: Column) -> Column:
    """Words and marks."""
    return F.regexp_count(text_of(c), F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_{BLANK}]"))


def token_estimate(t: Column, units: Column) -> Column:
    estimate = F.bround(F.greatest(F.length(t) / F.lit(4.0), F.lit(0.75) * units))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), estimate.cast("long"))).cast("long")


def token_count(c: Column) -> Column:
    """The larger of a quarter of the characters and three quarters of the words and marks, rounded half to even, at
    least 1; 0 for an empty text."""
    return token_estimate(text_of(c), token_units(c))


def model_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def price_per_mtok(model: Column, override: float | None = None, prices: dict[str, float] | None = None) -> Column:
    """USD per million input tokens; an override wins."""
    if override is not None:
        return F.lit(float(override))
    table = F.create_map(*[F.lit(x) for kv in (prices or PRICES).items() for x in kv])
    return F.coalesce(F.try_element_at(table, model_key(model)), F.lit(DEFAULT_PRICE))


def with_price(prices: dict[str, float], model: str, usd: float) -> dict[str, float]:
    """A new price list with one model set."""
    return prices | {model.strip().lower(): float(usd)}


def cost(tokens: Column, price: Column) -> Column:
    return tokens / F.lit(1_000_000.0) * price


_encodings: dict[str, object] = {}

#: A fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(path: str):
    """One per worker process; needs the optional tiktoken."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as rows:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def bpe_token_count(c: Column, path: str) -> Column:
    """Exact counts by a vocabulary file of ranks that every executor has at the path; null where it can't be used."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            encode = _encoding(path).encode_ordinary
        except (ImportError, OSError, ValueError):
            encode = None
        for texts in batches:
            yield texts.map(lambda t: None if encode is None else len(encode(t))).astype("Int64")

    return count(text_of(c))


def count_tokens(c: Column, backend: str = "heuristic", path: str | None = None) -> Column:
    """Tokens by the backend asked for; the estimate stands in where a vocabulary is missing."""
    if backend == "heuristic" or not path:
        return token_count(c)
    return F.coalesce(bpe_token_count(c, path), token_count(c))
