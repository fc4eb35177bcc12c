"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")), ["doc_id"])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_words

    return mixed_words(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"))


def op7_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import cut
    from .sharding import keyed, shard_by_bytes

    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    slim = cut(docs.select("doc_id", "k1", "k2", "size", crc.alias("text_crc32")))
    out = shard_by_bytes(slim, slim.select("k1", "k2", "size"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return digests(format_conversations(turns.unionByName(planted)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_lm_scoring, op3_toxicity, op4_source_mixing, op5_simhash_near_dedup, op6_best_fit_packing, op7_va_file_top_k, op8_histogram_sort_shards, op9_chat_formatting, op10_license_scan)}

_FINE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
  r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a),
  c AS (SELECT id, min(root) AS root FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, c.id = c.root AS kept FROM c LEFT JOIN n ON c.id = n.a""",
    "op7_va_file_top_k": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_FINE}),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op9_chat_formatting": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
  o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, length(role) + 4 + 2 + 8 + length(text) + length(text) - length(replace(text, chr(92), ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) AS chars FROM t),
  f AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
      WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE before = 'tool' AND role IN ('assistant', 'tool') END AS fits FROM o)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid FROM f GROUP BY conv_id""",
}
