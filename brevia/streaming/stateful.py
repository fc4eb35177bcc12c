"""Streams: windowed savings, exact deduplication, and append to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_count


def windowed_tokens(events: DataFrame, ts: str = "ts", text: str = "props", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, tokens) by event time; rows later than the watermark are dropped when it streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(token_count(F.col(text))).alias("tokens"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "tokens")


def distinct_payloads(rows: DataFrame, ts: str, text: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose text wasn't seen within the watermark."""
    keyed = rows.withColumn("digest", F.sha2(F.col(text), 256))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["digest"]) if rows.isStreaming else keyed.dropDuplicates(["digest"])


def running_totals(results: DataFrame) -> DataFrame:
    """Cumulative savings by kind; write with output mode complete or update."""
    return results.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("saved_tokens").alias("saved_tokens"))


def store_stream(entries: DataFrame, path: str, checkpoint: str):
    """Appends a stream of store entries; a batch that is tried again overwrites its own folder, so none is doubled."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
