"""The batch forms of what services do: request keys, a response cache with expiry, tool replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Options
from .pipeline import compact

#: The request fields that decide an answer. Fixed values.
KEY_FIELDS = ("messages", "model", "response_format", "temperature", "tool_choice", "tools", "top_p")


def request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 over the deciding fields in the order of their names; missing ones are null."""
    named = [F.concat(F.lit(f'"{k}": '), F.coalesce(fields.get(k, F.lit(None)).cast("string"), F.lit("null"))) for k in KEY_FIELDS]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *named), F.lit("}")), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """requests (key, ...) with the newest cached body that hasn't expired, and whether there was one."""
    fresh = cache.where((F.lit(ttl) <= 0) | (F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl))
    newest = fresh.groupBy("key").agg(F.max_by("body", "created_at").alias("cached"))
    return requests.join(newest, "key", "left").withColumn("hit", F.col("cached").isNotNull())


def cache_capped(cache: DataFrame, most: int = 1024) -> DataFrame:
    """The newest entries of a cache: those put in first go first. The order is total, ties go by key."""
    return cache.orderBy(F.desc("created_at"), "key").limit(most)


def tool_reply(df: DataFrame, key: str, text: str, level: str | None = None) -> DataFrame:
    """(key, reply): the compacted text under a line that says what was saved."""
    done = compact(df, key, text, Options().merged(level=level, min_tokens=0))
    head = F.format_string("%s: %d → %d tokens (%s%% saved)\n", F.col("kind"), F.col("original_tokens"), F.col("compressed_tokens"), F.bround(F.col("ratio") * 100, 1).cast("string"))
    return done.select(key, F.concat(head, F.col("text")).alias("reply"))


def tool_retrieve(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(ref, reply): the original, or a line that says there is none. found: (ref, content)."""
    none = F.concat(F.lit("No stored content for ref '"), F.col("ref"), F.lit("' (expired or unknown)."))
    return asked.join(found, "ref", "left").select("ref", F.coalesce("content", none).alias("reply"))


def tokens_saved(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), before - after).cast("long")


