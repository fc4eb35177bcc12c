"""Near-duplicate payloads, blocks and messages, and SimHash fingerprints."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import shingles, text_of, words

#: Similarity of duplicates, share of lengths below which nothing is compared, characters compared.
THRESHOLD, LENGTH_SHARE, COMPARED = 0.85, 0.6, 6000


def similarity(a: str, b: str) -> float:
    """Sequence similarity from 0 to 1; the order of arguments matters."""
    if a == b:
        return 1.0
    short, long_ = sorted((len(a), len(b)))
    if not short or short / long_ < LENGTH_SHARE:
        return 0.0
    return compared(a[:COMPARED], b[:COMPARED])


def compared(a: str, b: str) -> float:
    """The matcher's ratio, or its cheap bound from above where that is low already."""
    m = difflib.SequenceMatcher(None, a, b)
    quick = m.quick_ratio()
    return quick if quick < LENGTH_SHARE else m.ratio()


@F.pandas_udf(T.DoubleType())
def _compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """compared() of two columns; null where either is null."""
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else compared(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def may_be_similar(a: Column, b: Column) -> Column:
    """False where lengths alone rule similarity at the threshold out."""
    x, y = F.length(a), F.length(b)
    return (a == b) | (F.least(x, y) / F.greatest(x, y) >= F.lit(LENGTH_SHARE))


def near_duplicate(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Equal texts and hopeless lengths are told by the JVM; the worker sees null for them, and of others what is compared alone."""
    maybe = may_be_similar(a, b) & (a != b)
    seen = _compared(F.when(maybe, F.substring(a, 1, COMPARED)), F.when(maybe, F.substring(b, 1, COMPARED)))
    return (a == b) | F.coalesce(seen >= threshold, F.lit(False))


_GAP = re.compile(r"(\n\s*\n)")


def collapse_blocks(text: str, threshold: float = THRESHOLD) -> str:
    """Drops blocks that are like the last block kept, and says how many stood there; under three blocks nothing changes."""
    parts = _GAP.split(text)
    if len(parts) < 5:
        return text
    out: list[str] = []
    kept, run = None, 1
    for block, gap in zip(parts[::2], [*parts[1::2], ""], strict=True):
        bare = block.strip()
        if bare and kept is not None and similarity(bare, kept) >= threshold:
            run += 1
            continue
        if bare:
            if run > 1:
                out.append(f"\n[× {run} near-identical blocks collapsed]\n")
            kept, run = bare, 1
        out.append(block + gap)
    if run > 1:
        out.append(f"\n[× {run} near-identical blocks collapsed]\n")
    short = "".join(out)
    return short if len(short) < len(text) else text


@F.pandas_udf(T.StringType())
def _collapse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else collapse_blocks(t))


def dedup_blocks(text: Column) -> Column:
    """collapse_blocks() of a column; only texts with two gaps or more go to the worker."""
    t = text_of(text)
    return F.coalesce(_collapse(F.when(F.regexp_count(t, F.lit(r"\n\s*\n")) >= 2, t)), t)


#: What SQL's trim() takes off: Unicode's space separators, and no other blanks.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def exact_block_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, block, times): runs of equal neighbouring blocks, as windows find them. Gaps hold SQL's blanks, so no vertical tabs."""
    # trim's second argument is what to trim: given bare to transform() it gets the place of the block
    blocks = F.transform(F.split(text_of(F.col(text)), r"\n[\t\n\f\r ]*\n", -1), lambda b: F.trim(b, F.lit(SPACES)))
    rows = df.repartition(key).select(key, F.posexplode(blocks).alias("pos", "block")).where("block <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    fresh = F.coalesce(F.col("block") != F.lag("block").over(w), F.lit(True)).cast("int")
    rows = rows.withColumn("run", F.sum(fresh).over(w))
    return rows.groupBy(key, "run").agg(F.min_by("block", "pos").alias("block"), F.count("*").alias("times"))


def first_equal(df: DataFrame, text: str, order: str, out: str = "first_id") -> DataFrame:
    """df with the first row of equal text: an aggregation by the text's digest and a join back, skew split by Spark."""
    digest = F.sha2(text_of(F.col(text)), 256)
    first = df.groupBy(digest.alias("_d")).agg(F.min(order).alias(out))
    return df.withColumn("_d", digest).join(first, "_d").drop("_d")


def simhash_blake2b(tokens: list[str], k: int = 3) -> int:
    """64-bit SimHash over BLAKE2b digests of shingles, as a signed long."""
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    raw = b"".join(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest() for g in grams)
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int.from_bytes(np.packbits(2 * bits.astype(np.int64) > len(grams)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for tokens in batches:
        yield tokens.map(lambda t: simhash_blake2b(list(t)))


def simhash(text: Column) -> Column:
    """SimHash by BLAKE2b; words come from the JVM, digests from Arrow batches."""
    return _simhash(words(text_of(text)))


def simhash_sha256(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp): SimHash by the first eight bytes of SHA-256, with column functions alone."""
    grams = df.select(key, F.explode_outer(shingles(words(text_of(F.col(text))))).alias("g"))
    half = lambda a: F.conv(F.substring(F.sha2("g", 256), a, 8), 16, 10).cast("long")
    rows = grams.select(key, half(1).alias("hi"), half(9).alias("lo"))
    votes = [F.sum(F.getbit("lo" if b < 32 else "hi", F.lit(b % 32)).cast("int")).alias(f"b{b}") for b in range(64)]
    per = rows.groupBy(key).agg(F.count("hi").alias("n"), *votes)
    bit = lambda b: F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)).otherwise(F.lit(0)).cast("long")
    fp = bit(0)
    for b in range(1, 64):
        fp = fp.bitwiseOR(bit(b))
    return per.select(key, fp.alias("fp"))
