"""Passage ranking: TF-IDF with the query counted as a document, cosine, and the best passages kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of
from ..functions.tokens import token_count
from ..sources.scratch import staged
from .prose import compact_prose

TERM = r"([A-Za-z0-9][A-Za-z0-9'_-]+)"


#: Rows of queries' terms that are broadcast, at most some MB.
MOST_TERMS = 100_000


def terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(TERM), F.lit(1)), F.lower)


def term_shares(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """(chunk_id, term, tf): share of a chunk's terms."""
    rows = chunks.select(chunk_id, terms(F.col(text)).alias("t")).select(chunk_id, F.size("t").alias("len"), F.explode("t").alias("term"))
    return rows.groupBy(chunk_id, "term").agg((F.count("*") / F.first("len")).alias("tf"))


def term_weights(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """(chunk_id, term, tf, df): share of a chunk's terms, and number of chunks with the term."""
    tf = term_shares(chunks, chunk_id, text)
    return tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term")


def scores(chunks: DataFrame, queries: DataFrame, chunk_id: str = "chunk_idx", text: str = "chunk", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, chunk_id, score) of the pairs that share a term; all others score 0.

    A query changes the inverse document frequency of its own terms alone, so a chunk's norm is that without the query,
    corrected on the terms shared. Term shares are written once. The weights of a chunk are brought together, and stay together: its norm, the
    join with the queries' terms (broadcast up to MOST_TERMS rows) and the sums by query need no further exchange, so pairs
    exist only inside tasks, and of them a window's group limit lets the best through.
    """
    n = chunks.count()
    tf = staged(term_shares(chunks, chunk_id, text))
    df = staged(tf.groupBy("term").agg(F.count("*").alias("df")))
    idf = lambda df: F.log(F.lit(n + 2.0) / (df + 1)) + 1.0  # noqa: E731  the query makes one more document
    asked = term_shares(queries, query_id, query).withColumnRenamed("tf", "qtf").join(df, "term", "left")
    q = staged(asked.select(query_id, "term", (F.col("qtf") * idf(F.coalesce("df", F.lit(0)) + 1)).alias("qw")))
    qnorm = q.groupBy(query_id).agg(F.sum(F.col("qw") * F.col("qw")).alias("qnorm"))
    w = tf.join(df, "term").select(chunk_id, "term", (F.col("tf") * idf(F.col("df"))).alias("w0"), (F.col("tf") * idf(F.col("df") + 1)).alias("w1"))
    w = w.repartition(chunk_id).withColumn("norm0", F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy(chunk_id)))
    few = q.count() <= MOST_TERMS
    hits = w.join(F.broadcast(q) if few else q, "term")
    pairs = hits.groupBy(query_id, chunk_id).agg(
        F.sum(F.col("qw") * F.col("w1")).alias("dot"), F.sum(F.col("w1") * F.col("w1") - F.col("w0") * F.col("w0")).alias("more"), F.first("norm0").alias("norm0")
    )
    pairs = pairs.join(F.broadcast(qnorm) if few else qnorm, query_id)
    return pairs.select(query_id, chunk_id, F.round(F.col("dot") / (F.sqrt(F.col("norm0") + F.col("more")) * F.sqrt("qnorm")), 9).alias("score"))


def rank(chunks: DataFrame, queries: DataFrame, k: int, chunk_id: str = "chunk_idx", query_id: str = "query_id", **names) -> DataFrame:
    """(query_id, chunk_id, score, rk) of the k best chunks with a score above 0, earlier ones first among equals."""
    rk = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id))
    found = scores(chunks, queries, chunk_id=chunk_id, query_id=query_id, **names)
    return found.where("score > 0").withColumn("rk", rk).where(F.col("rk") <= k)


def compact_passages(
    chunks: DataFrame, queries: DataFrame, keep: float = 0.45, max_chunks: int | None = None, chunk_id: str = "chunk_idx", text: str = "chunk",
    query_id: str = "query_id", query: str = "query", normalized: bool = True,
) -> DataFrame:
    """(query_id, chunk_id, compacted, original_tokens, compressed_tokens): the passages kept for each query, compacted as prose, in their order.

    Without max_chunks a share of all chunks is kept; with 0 the best one. A query that no chunk shares a term with keeps the first chunk.
    """
    if max_chunks is not None and max_chunks < 0:
        raise ValueError("max_chunks must not be negative")
    k = max(1, int(chunks.count() * keep) if max_chunks is None else max_chunks)
    kept = staged(rank(chunks, queries, k, chunk_id=chunk_id, query_id=query_id, text=text, query=query).select(query_id, chunk_id))
    first = F.lit(chunks.agg(F.min(chunk_id)).first()[0]).cast(chunks.schema[chunk_id].dataType)
    none = queries.select(query_id).join(kept.select(query_id).distinct(), query_id, "left_anti").withColumn(chunk_id, first)
    kept = kept.unionByName(none.select(query_id, chunk_id))
    # a passage that several queries keep is compacted once
    used = chunks.join(kept.select(chunk_id).distinct(), chunk_id, "left_semi")
    short = compact_prose(used.select(chunk_id, text), chunk_id, text, keep, normalized)
    short = short.select(chunk_id, "compacted", token_count(F.col(text)).alias("original_tokens"), token_count(F.col("compacted")).alias("compressed_tokens"))
    return kept.join(short, chunk_id).select(query_id, chunk_id, "compacted", "original_tokens", "compressed_tokens")


def passage_savings(chunks: DataFrame, kept: DataFrame, query_id: str = "query_id", text: str = "chunk") -> DataFrame:
    """A result per query for telemetry, of kind rag: tokens of all chunks before, of the compacted ones kept after."""
    before = chunks.agg(F.coalesce(F.sum(token_count(F.col(text))), F.lit(0)).alias("original_tokens"))
    after = kept.groupBy(query_id).agg(F.sum("compressed_tokens").alias("compressed_tokens"))
    # before is one row
    rows = after.join(F.broadcast(before))
    return rows.select(query_id, F.lit("rag").alias("kind"), "original_tokens", "compressed_tokens", F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens")).alias("saved_tokens"))
