"""Plumbing shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import table  # noqa: F401  used by the queries
from ..sources.scratch import dropped, shared_dir

#: What separates words in most contracts: the six ASCII blanks. bytes.split() splits on exactly these.
BLANKS = r"[^\x20\x09-\x0D]+"


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only and splits on ASCII blanks; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def arrow_batch(schema: T.StructType, columns: Sequence) -> pa.RecordBatch:
    """A batch of columns given as Arrow arrays, numpy arrays or lists."""
    made = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=_ARROW[f.dataType.simpleString()]) for f, c in zip(schema.fields, columns, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=schema.names)


def map_texts(df: DataFrame, keep: Sequence[str], added: str, fn: Callable[[list], Sequence]) -> DataFrame:
    """The columns kept, as they are, and the columns `added` (DDL) that fn makes of a list of texts. No shuffle.

    text may be kept, too. Names kept and added must differ.
    """
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*(df.schema[k] for k in keep), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = arrow_batch(new, fn(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made.columns], names=schema.names)

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


#: Folders of the checkpoints made by this process and not yet deleted, oldest first.
_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    _made.append(_folder(out))
    return out


def _folder(checkpointed: DataFrame) -> str:
    return checkpointed._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


def forget(df: DataFrame) -> None:
    """Deletes the checkpoint of what cut() gave and nothing needs any more."""
    path = _folder(df)
    _made.remove(path)
    dropped(df.sparkSession, path)


@contextmanager
def forgotten(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the checkpoints made meanwhile: what they led to must be written by then."""
    mark = len(_made)
    try:
        yield
    finally:
        while len(_made) > mark:
            dropped(spark, _made.pop())
        spark.sparkContext._jvm.System.gc()  # the files of shuffles that nothing refers to go with their objects


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a long, b long): one row (node, root) per linked node.

    root is the smallest node of the component. Alternates large-star and small-star steps (Kiveris et al., 2014):
    each round is two aggregations and two joins over at most as many links as there were, and links of a
    component shrink to a star in a logarithmic number of rounds. Nothing reaches the driver but a checksum.
    """
    stars = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        check = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if check["n"] == 0 or check == seen:
            break
        seen = check
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        last, stars = stars, cut(small.where("u <> v").distinct())
        forget(last)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the smallest node among each u and its neighbours, dealt anew: so the join with it is of two plain exchanges, of which Spark
    splits a partition that a centre with very many links makes large."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")).repartition(F.xxhash64("u"))


def hashable(df: DataFrame) -> list:
    """The columns that have a hash, in order of their names: all but those that hold maps or variants."""
    fine = [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return [df[c] for c in sorted(fine)]


def crc32_mod(column: str, modulus: int):
    """crc32 of a column's text form modulo a number; null gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
