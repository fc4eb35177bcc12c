"""Where payloads come from and go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files. The path is a pattern, as a stream takes any other path for a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): one row per file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"))


def write_payloads(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)
