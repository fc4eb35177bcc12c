"""Log compaction: runs of lines that differ in numbers, times and ids alone become one line with a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, strip, text_of

#: What a template masks, in this order, and the words of severe lines.
MASKS = [
    (r"(?U)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?U)\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"(?U)\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r"(?U)\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<time>"),
    (r"(?U)\b\d+\b", "<n>"),
]
SEVERE = r"(?iU)\b(error|fatal|critical|exception|traceback|panic|fail(?:ed|ure)?|warn(?:ing)?)\b"


def template(line: Column) -> Column:
    for pattern, mask in MASKS:
        line = F.regexp_replace(line, pattern, mask)
    return strip(line)


def log_lines(df: DataFrame, key: str, text: str, keep: float = 0.45) -> DataFrame:
    """(key, pos, line, template, forced): forced lines are the first and last, and severe ones with their neighbours."""
    edge, near = (5, 2) if keep >= 0.4 else (3, 1)
    rows = df.repartition(key).select(key, F.posexplode(lines(text_of(F.col(text)))).alias("pos", "line"))
    w = Window.partitionBy(key)
    severe = F.max(F.col("line").rlike(SEVERE)).over(w.orderBy("pos").rowsBetween(-near, near))
    n = F.count("*").over(w)
    forced = severe | (F.col("pos") < edge) | (F.col("pos") >= n - edge)
    return rows.select(key, "pos", "line", template(F.col("line")).alias("template"), forced.alias("forced"), n.alias("n"))


def log_runs(df: DataFrame, key: str, text: str, keep: float = 0.45) -> DataFrame:
    """(key, run, pos, line, n, lines): the first line of each run and how many it stands for."""
    rows = log_lines(df, key, text, keep)
    w = Window.partitionBy(key).orderBy("pos")
    fresh = F.col("forced") | F.coalesce(F.lag("forced").over(w), F.lit(True)) | (F.col("template") != F.lag("template").over(w))
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(w))
    return rows.groupBy(key, "run").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.count("*").alias("times"), F.max("n").alias("n"))


def compact_logs(df: DataFrame, key: str, text: str, keep: float = 0.45, out: str = "compacted") -> DataFrame:
    """df with its logs compacted; fewer than eight lines, or no gain, leave a text as it is."""
    runs = log_runs(df.select(key, text), key, text, keep)
    shown = F.when(F.col("times") == 1, F.col("line")).otherwise(F.concat("line", F.lit("    [× "), F.col("times").cast("string"), F.lit(" similar lines]")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown"))))
    short = runs.where("n >= 8").groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x.shown), "\n").alias("_short"))
    whole = text_of(F.col(text))
    best = F.when(F.length("_short") < F.length(whole), F.col("_short")).otherwise(whole)
    return df.join(short, key, "left").withColumn(out, F.coalesce(best, whole)).drop("_short")
