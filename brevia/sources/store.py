"""The store of originals: an append-only Parquet table, the newest entry of a reference counts, entries expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ref string, content string, kind string, created_at timestamp"


def latest(entries: DataFrame) -> DataFrame:
    """One entry per reference, the newest."""
    return entries.groupBy("ref").agg(F.max_by(F.struct("content", "kind"), "created_at").alias("e"), F.max("created_at").alias("created_at")).select("ref", "e.content", "e.kind", "created_at")


def alive(entries: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Entries that haven't expired; a ttl of 0 or less keeps all."""
    return entries if ttl <= 0 else entries.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl)


def wanted_ref(c: Column, marker: str = "brevia:ref") -> Column:
    """The reference in a text's first marker, else the stripped text itself."""
    inside = F.regexp_extract(c, rf"\[{marker}\s+([0-9a-f]{{6,}})", 1)
    return F.when(inside != "", inside).otherwise(F.trim(c))


def retrieve(asked: DataFrame, column: str, entries: DataFrame, now: Column, ttl: int, marker: str = "brevia:ref") -> DataFrame:
    """asked with ref and content (null if unknown or expired)."""
    found = alive(latest(entries), now, ttl).select("ref", "content")
    return asked.withColumn("ref", wanted_ref(F.col(column), marker)).join(found, "ref", "left")


class Store:
    """A store at a path."""

    def __init__(self, spark: SparkSession, path: str, ttl: int = 86_400) -> None:
        self.spark, self.path, self.ttl = spark, path, ttl

    def put(self, entries: DataFrame) -> None:
        entries.select("ref", "content", "kind", "created_at").write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def get(self, asked: DataFrame, column: str = "ref", now: Column | None = None) -> DataFrame:
        return retrieve(asked, column, self.entries(), F.current_timestamp() if now is None else now, self.ttl)

    def rewrite(self, path: str, without: DataFrame | None = None, now: Column | None = None) -> int:
        """Writes the living, newest entries, less the references given, to another path; returns how many were left out."""
        every = latest(self.entries())
        kept = alive(every, F.current_timestamp() if now is None else now, self.ttl)
        if without is not None:
            kept = kept.join(without.select("ref"), "ref", "left_anti")
        kept.write.mode("overwrite").parquet(path)
        return every.count() - self.spark.read.parquet(path).count()
