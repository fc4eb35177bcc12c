"""Telemetry of compaction runs as aggregates over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def telemetry(results: DataFrame, calls: int = 0) -> DataFrame:
    """One row of totals. Passed-through payloads aren't counted; results of retried tasks count once."""
    rows = results.where("kind <> 'passthrough'")
    out = rows.agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("compressed_tokens"),
        F.coalesce(F.sum("cost_saved_usd"), F.lit(0.0)).alias("cost"), F.coalesce(F.avg("fidelity"), F.lit(1.0)).alias("fid"),
        F.count_if("reverted").alias("reverted_low_quality"), F.coalesce(F.sum("secrets"), F.lit(0)).alias("secrets_redacted"),
    )
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens"))
    pct = F.when(F.col("original_tokens") == 0, 0.0).otherwise((1.0 - F.col("compressed_tokens") / F.col("original_tokens")) * 100)
    return out.select(
        F.lit(calls).cast("long").alias("calls"), "blocks", "original_tokens", "compressed_tokens", saved.cast("long").alias("saved_tokens"), F.bround(pct, 1).alias("reduction_pct"),
        F.bround("cost", 4).alias("cost_saved_usd"), F.bround("fid", 3).alias("avg_fidelity"), "reverted_low_quality", "secrets_redacted",
    )


def savings_by_kind(results: DataFrame) -> DataFrame:
    """(kind, saved): original minus compacted tokens, which may be negative."""
    return results.where("kind <> 'passthrough'").groupBy("kind").agg(F.sum(F.col("original_tokens") - F.col("compressed_tokens")).alias("saved"))


def perf_report(results: DataFrame, price: float = 2.50, calls_per_day: int = 10_000) -> DataFrame:
    """Per kind and in total (kind TOTAL): tokens before and after, percent and USD saved, and the projection by day and month.

    Figures keep nine decimals; rounding for show is left to whoever shows them.
    """
    rows = results.where("kind <> 'passthrough'").rollup("kind").agg(
        F.sum("original_tokens").alias("before"), F.sum("compressed_tokens").alias("after"), F.avg(F.when(F.col("kind").isin("text", "table"), F.col("fidelity"))).alias("fid"), F.grouping("kind").alias("g")
    )
    usd = (F.col("before") - F.col("after")) / 1e6 * F.lit(float(price))
    total = F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("kind")).alias("kind")
    pct = (1.0 - F.col("after") / F.col("before")) * 100
    figures = {"saved_pct": pct, "quality": F.col("fid"), "usd_saved": usd, "usd_day": usd * calls_per_day, "usd_month": usd * calls_per_day * 30}
    return rows.select(total, "before", "after", *(F.round(c, 9).alias(n) for n, c in figures.items()))
