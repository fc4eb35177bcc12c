"""Stages written once and read as often as a plan needs them, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; also where checkpoints go.

    Without that setting a session on a single machine gets a temporary folder; any other session is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="brevia-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can reach it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df as Parquet and reads it again; `by` makes a folder per value, so a reader of one value skips the others."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
