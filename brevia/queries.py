"""The engine's named queries, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.redact import redact
from .functions.route import detect, log_line_ratio, table_ratio
from .functions.text import hamming, jaccard, words
from .functions.tokens import cost, price_per_mtok, token_count
from .operators import code, dedup, logs, prose, rag, records
from .operators.fidelity import fidelity, gate, token_counts
from .options import Options
from .plans import conversations as conv
from .plans import report, services
from .plans.pipeline import compact, reference_of
from .sources import store
from .sources.readers import streamed, table
from .streaming import keyed
from .streaming.stateful import windowed_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ---- SQL building blocks ----

WORDS_SQL = r"[\p{L}\p{N}_]+"


def sql_tokens(x: str) -> str:
    n = rf"len(regexp_extract_all({x}, '{WORDS_SQL}|[^\p{{L}}\p{{N}}_\s]'))"
    return f"CASE WHEN length({x}) = 0 THEN 0::BIGINT ELSE greatest(1, CAST(round_even(greatest(length({x}) / 4.0::DOUBLE, 0.75::DOUBLE * {n}), 0) AS BIGINT))::BIGINT END"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_price(x: str) -> str:
    return f"CASE lower(trim({x})) WHEN 'economy' THEN 0.3::DOUBLE WHEN 'standard' THEN 3::DOUBLE WHEN 'premium' THEN 15::DOUBLE ELSE 2.5::DOUBLE END"


def sql_norm(x: str) -> str:
    marks = r"\*\*(\S(?:.*?\S)??)\*\*|__(\S(?:.*?\S)??)__|\*(\S(?:.*?\S)??)\*|_(\S(?:.*?\S)??)_"
    out = rf"regexp_replace({x}, '{marks}', '\1\2\3\4', 'g')"
    out = rf"regexp_replace({out}, '(?m)[ \t]+$', '', 'g')"
    out = rf"regexp_replace({out}, '[ \t]{{2,}}', ' ', 'g')"
    return rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"


LOGS_SQL = """SELECT user_id AS id, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_type = 'error' THEN ' ERROR ' ELSE ' INFO ' END
  || event_type || ' worker=' || (event_id % 4)::VARCHAR || ' req-' || event_id::VARCHAR, chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id"""

JSON_SQL = """SELECT o_custkey AS id, '[' || string_agg('{"id": ' || o_orderkey::VARCHAR || ', "status": "' || o_orderstatus || '", "priority": "' || o_orderpriority || '"}', ', ' ORDER BY o_orderkey) || ']' AS text
  FROM orders GROUP BY o_custkey HAVING count(*) >= 4"""

CODE_SQL = """SELECT p_partkey AS id, 'function f' || p_partkey::VARCHAR || '() {' || chr(10) || repeat('        step("' || p_name || '");' || chr(10), (p_size % 7)::BIGINT) || '  return ' || p_size::VARCHAR || ';' || chr(10) || chr(10)
  || '          // ' || p_brand || chr(10) || '}' AS text FROM part"""

BLOCKS_SQL = "SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"

STOP_SQL = ", ".join(f"'{w}'" for w in prose.STOPWORDS)


def sql_sentences(source: str) -> str:
    """CTEs up to s(id, idx, sentence, heading) over a source (id, t)."""
    return rf"""src AS ({source}),
  b AS (SELECT id, unnest(bs) AS block, generate_subscripts(bs, 1) AS bpos FROM (SELECT id, list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda x: regexp_matches(x, '\S')) AS bs FROM src)),
  h AS (SELECT id, bpos, regexp_matches(block, '^\s{{0,3}}#{{1,6}}\s') AS heading, {sql_strip('block')} AS whole FROM b),
  p AS (SELECT id, bpos, heading, unnest(ps) AS raw, generate_subscripts(ps, 1) AS spos FROM (SELECT *, CASE WHEN heading THEN [whole]
    ELSE list_filter(list_transform(string_split(regexp_replace(whole, '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: {sql_strip('x')}), lambda x: length(x) > 0) END AS ps FROM h)),
  s AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY bpos, spos) - 1 AS INTEGER) AS idx, raw AS sentence, heading FROM p)"""


SCORES_SQL = rf""",
  w AS (SELECT id, idx, unnest(list_filter(list_transform(regexp_extract_all(sentence, '[A-Za-z][A-Za-z''-]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains([{STOP_SQL}], x))) AS word FROM s WHERE NOT heading),
  tf AS (SELECT id, word, count(*) AS n FROM w GROUP BY id, word),
  mx AS (SELECT id, max(n) AS m FROM tf GROUP BY id),
  per AS (SELECT w.id, w.idx, sum(tf.n)::DOUBLE AS total, count(*)::DOUBLE AS k FROM w JOIN tf ON w.id = tf.id AND w.word = tf.word GROUP BY w.id, w.idx),
  sc AS (SELECT s.id, s.idx, s.sentence, s.heading, CASE WHEN s.heading THEN NULL WHEN per.k IS NULL THEN 0::DOUBLE
    ELSE round(total / m / sqrt(k) + CASE WHEN s.idx < 2 THEN 1::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN regexp_matches(s.sentence, '(?i)(^|[^\p{{L}}\p{{N}}_])(must|should|never|always|error|fail|because|therefore|note|warning|important|return|raises?)($|[^\p{{L}}\p{{N}}_])') THEN 0.6::DOUBLE ELSE 0::DOUBLE END, 9) END AS score
    FROM s JOIN mx ON s.id = mx.id LEFT JOIN per ON s.id = per.id AND s.idx = per.idx)"""

KEPT_SQL = """,
  rk AS (SELECT *, row_number() OVER (PARTITION BY id, heading ORDER BY score DESC, idx) AS r, count(*) OVER (PARTITION BY id, heading) AS c FROM sc),
  kept AS (SELECT id, idx, sentence, score, heading OR r <= greatest(1, trunc(c * 0.45::DOUBLE)) AS kept FROM rk)"""

# ---- payloads derived from the tables ----


def log_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_type") == "error", " ERROR ").otherwise(" INFO "), "event_type",
        F.lit(" worker="), (F.col("event_id") % 4).cast("string"), F.lit(" req-"), F.col("event_id").cast("string"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("text"))


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    item = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'), "o_orderstatus", F.lit('", "priority": "'), "o_orderpriority", F.lit('"}'))
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item"))))
    rows = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x.item), ", ").alias("items"))
    return rows.where("n >= 4").select("id", F.concat(F.lit("["), "items", F.lit("]")).alias("text"))


def code_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('        step("'), "p_name", F.lit('");\n'))
    text = F.concat(
        F.lit("function f"), F.col("p_partkey").cast("string"), F.lit("() {\n"), F.repeat(body, F.col("p_size") % 7), F.lit("  return "), F.col("p_size").cast("string"),
        F.lit(";\n\n          // "), "p_brand", F.lit("\n}"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


def block_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over the cores: inputs of one row group would run in one task."""
    return table(spark, sf_dir, "documents").repartition("doc_id")


# ---- tokens and prices ----


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def token_counts_by_doc(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t) / 1e6::DOUBLE * 2.5::DOUBLE, 6) AS usd FROM (SELECT lang, {sql_tokens('text')} AS t FROM documents) GROUP BY lang")
def token_cost_by_lang(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", token_count(F.col("text")).alias("t"))
    out = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"))
    return out.withColumn("usd", F.round(cost(F.col("tokens"), F.lit(2.5)), 6))


MODEL_SQL = "CASE role WHEN 'system' THEN ' Premium ' WHEN 'user' THEN 'economy' ELSE 'unlisted' END"


@query(f"SELECT conv_id, turn, {sql_price(MODEL_SQL)} AS usd_per_mtok, round(({sql_tokens('text')}) / 1e6::DOUBLE * ({sql_price(MODEL_SQL)}), 9) AS usd FROM conversations")
def price_lookup(spark, sf_dir):
    model = F.when(F.col("role") == "system", " Premium ").when(F.col("role") == "user", "economy").otherwise("unlisted")
    price = price_per_mtok(model)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", price.alias("usd_per_mtok"), F.round(cost(token_count(F.col("text")), price), 9).alias("usd"))


# ---- routing ----

LOG_LINE_SQL = r"(?i)^\s*(?:\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}:\d{2}|\[\d{2}:\d{2}:\d{2}\]|(?:trace|debug|info|warn|warning|error|fatal|critical)\b|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
CODE_LINE_SQL = r"(?m)^\s*(?:def |class |import |from \w+ import |func |package |public |private |const |let |var |#include|fn |impl |export |async def )"


def sql_lines(x: str, n: int) -> str:
    return rf"list_filter(string_split({x}, chr(10)), lambda ln: regexp_matches(ln, '\S'))[1:{n}]"


def sql_log_ratio(x: str) -> str:
    s = sql_lines(x, 200)
    return f"CASE WHEN len({s}) = 0 THEN 0::DOUBLE ELSE len(list_filter({s}, lambda ln: regexp_matches(ln, '{LOG_LINE_SQL}')))::DOUBLE / len({s}) END"


def sql_table_ratio(x: str) -> str:
    s = sql_lines(x, 60)
    share = lambda m: f"len(list_filter({s}, lambda ln: length(ln) - length(replace(ln, '{m}', '')) >= 2))"
    return f"CASE WHEN len({s}) < 3 THEN 0::DOUBLE ELSE greatest({share('|')}, {share(',')})::DOUBLE / len({s}) END"


def sql_kind(x: str) -> str:
    return rf"""CASE WHEN NOT regexp_matches({x}, '\S') THEN 'text' WHEN regexp_matches({x}, '(?m)^(?:diff --git|@@ |\+\+\+ |--- |index [0-9a-f]+)') THEN 'diff'
  WHEN regexp_matches({x}, '^\s*[\[{{]') AND json_valid({sql_strip(x)}) THEN 'json' WHEN ({sql_log_ratio(x)}) >= 0.4::DOUBLE THEN 'log'
  WHEN regexp_matches({x}, '{CODE_LINE_SQL}') THEN 'code' WHEN ({sql_table_ratio(x)}) >= 0.6::DOUBLE THEN 'table' ELSE 'text' END"""


@query(f"SELECT doc_id, {sql_kind('text')} AS kind FROM documents")
def route_kind(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", detect(F.col("text")).alias("kind"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT {sql_kind('text')} AS kind FROM (SELECT text FROM documents UNION ALL SELECT text FROM ({LOGS_SQL}) UNION ALL SELECT text FROM ({JSON_SQL}) UNION ALL SELECT text FROM ({CODE_SQL}))) GROUP BY kind")
def route_histogram(spark, sf_dir):
    every = docs(spark, sf_dir).select("text")
    for f in (log_payloads, json_payloads, code_payloads):
        every = every.union(f(spark, sf_dir).select("text"))
    return every.select(detect(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT id, round({sql_log_ratio('text')}, 9) AS ratio FROM ({LOGS_SQL})")
def log_line_share(spark, sf_dir):
    return log_payloads(spark, sf_dir).select("id", F.round(log_line_ratio(F.col("text")), 9).alias("ratio"))


@query(f"SELECT doc_id, round({sql_table_ratio('text')}, 9) AS ratio FROM documents")
def table_line_share(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(table_ratio(F.col("text")), 9).alias("ratio"))


# ---- redaction ----

_START = r"(^|[^\p{L}\p{N}_])"
BEARER_SQL = rf"(?i){_START}(bearer)\s+[A-Za-z0-9._-]{{16,}}"
ASSIGN_SQL = rf"""(?i){_START}([A-Za-z0-9_]*(?:password|passwd|secret|api[_-]?key|token|access[_-]?key))\s*[:=]\s*["'']?([^\s"'',}}]{{6,}})["'']?"""
SECRET_PARTS = [("AKIA", 16, "A1"), ("ghp_", 36, "a1"), ("xoxb-", 12, "b2"), ("sk-", 24, "c3"), ("AIza", 35, "d4x")]



def secret_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after one made-up secret each, of a shape by their id."""
    made = [F.concat(F.lit(head), F.substring(F.repeat(F.lit(unit), n), 1, n)) for head, n, unit in SECRET_PARTS]
    made += [F.concat(F.lit("Bearer "), F.repeat(F.lit("z9"), 10)), F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.concat(F.lit("my_password = '"), F.repeat(F.lit("pq"), 5), F.lit("'"))]
    kinds = F.element_at(F.array(*made), (F.col("doc_id") % len(made) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("see "), kinds, F.lit(" end\n"), "text").alias("text"))


SECRETS_SQL = (
    "SELECT doc_id, 'see ' || (["
    + ", ".join(f"'{h}' || substr(repeat('{u}', {n}), 1, {n})" for h, n, u in SECRET_PARTS)
    + ", 'Bearer ' || repeat('z9', 10), '-----BEGIN RSA PRIVATE KEY-----', 'my_password = ''' || repeat('pq', 5) || ''''])[(doc_id % 8 + 1)::BIGINT] || ' end' || chr(10) || text AS text FROM documents"
)


def sql_redacted(source: str) -> str:
    """CTEs up to r9(doc_id, t, n)."""
    simple = [
        (rf"{_START}AKIA[0-9A-Z]{{16}}\b", r"\1<redacted:aws_access_key>"), (rf"{_START}gh[pousr]_[A-Za-z0-9]{{36,}}\b", r"\1<redacted:github_token>"),
        (rf"{_START}xox[baprs]-[A-Za-z0-9-]{{10,}}\b", r"\1<redacted:slack_token>"), (rf"{_START}sk-[A-Za-z0-9_-]{{20,}}\b", r"\1<redacted:openai_key>"),
        (rf"{_START}AIza[0-9A-Za-z_-]{{35}}\b", r"\1<redacted:google_api_key>"),
        (rf"{_START}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\b", r"\1<redacted:jwt>"),
        ("-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "<redacted:private_key>"), (BEARER_SQL, r"\1\2 <redacted:bearer_token>"), (ASSIGN_SQL, r"\1\2=<redacted:assignment_secret>"),
    ]
    out, last = f"r0 AS (SELECT doc_id, text AS t, 0::BIGINT AS n FROM ({source}))", 0
    for i, (p, r) in enumerate(simple, 1):
        out += f", r{i} AS (SELECT doc_id, regexp_replace(t, '{p}', '{r}', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n FROM r{last})"
        last = i
    return out


@query(f"WITH {sql_redacted(SECRETS_SQL)} SELECT doc_id, CAST(n AS BIGINT) AS secrets FROM r9")
def redact_hits(spark, sf_dir):
    return redact(secret_payloads(spark, sf_dir)).select("doc_id", "secrets")


@query(f"WITH {sql_redacted(SECRETS_SQL)} SELECT doc_id, length(t)::BIGINT AS chars, sha256(t) AS digest FROM r9")
def redact_text(spark, sf_dir):
    out = redact(secret_payloads(spark, sf_dir))
    return out.select("doc_id", F.length("redacted").cast("long").alias("chars"), F.sha2("redacted", 256).alias("digest"))


# ---- fidelity ----

TELLING_SQL = [
    r"\b\d[\d.,_]*\b",
    r"\b(?:[A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]+|[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)+|[A-Za-z0-9]+-[A-Za-z0-9-]+)\b",
    r"\b[A-Z][a-zA-Z0-9]{2,}\b",
    r"(?i)\b(?:error|fatal|critical|exception|fail(?:ed|ure)?|warn(?:ing)?|must|never|always|because|return|raises?)\b",
]


def sql_telling(x: str) -> str:
    return "list_transform(" + " || ".join(f"regexp_extract_all({x}, '{p}')" for p in TELLING_SQL) + ", lambda k: lower(k))"


FIDELITY_SQL = f"""WITH l AS ({LOGS_SQL}), x AS (SELECT id, text AS a, substr(text, 1, length(text) // 2) AS b FROM l),
  t AS (SELECT id, unnest({sql_telling('a')}) AS tok, 1 AS o, 0 AS c FROM x UNION ALL SELECT id, unnest({sql_telling('b')}), 0, 1 FROM x),
  g AS (SELECT id, tok, sum(o) AS o, sum(c) AS c FROM t GROUP BY id, tok),
  f AS (SELECT id, round(sum(least(o, c))::DOUBLE / sum(o), 9) AS fidelity FROM g GROUP BY id)"""


def _halved(spark, sf_dir):
    rows = log_payloads(spark, sf_dir)
    rows = rows.withColumn("half", F.expr("substring(text, 1, length(text) div 2)"))
    return fidelity(rows, "id", "text", "half").withColumn("fidelity", F.round("fidelity", 9))


@query(f"WITH l AS ({LOGS_SQL}) SELECT id, tok AS token, count(*) AS n FROM (SELECT id, unnest({sql_telling('text')}) AS tok FROM l) GROUP BY id, tok")
def important_tokens(spark, sf_dir):
    return token_counts(log_payloads(spark, sf_dir), "id", "text")


@query(FIDELITY_SQL + " SELECT id, fidelity FROM f")
def fidelity_truncated(spark, sf_dir):
    return _halved(spark, sf_dir).select("id", "fidelity")


@query(FIDELITY_SQL + " SELECT id, fidelity < 0.5::DOUBLE AS reverted, CASE WHEN fidelity < 0.5::DOUBLE THEN length(a) ELSE length(b) END::BIGINT AS chars FROM f JOIN x USING (id)")
def quality_gate(spark, sf_dir):
    rows = _halved(spark, sf_dir)
    back = gate(F.lit("text"), F.col("text"), F.col("half"), F.col("fidelity"), 0.5)
    return rows.select("id", back.alias("reverted"), F.length(F.when(back, F.col("text")).otherwise(F.col("half"))).cast("long").alias("chars"))


# ---- similarity ----

W = "PARTITION BY conv_id ORDER BY turn"


def sql_shingles(t: str) -> str:
    """Shingles of a column of words."""
    return f"CASE WHEN len({t}) >= 3 THEN list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]) WHEN len({t}) = 0 THEN []::VARCHAR[] ELSE [array_to_string({t}, ' ')] END"


def sql_words(table_name: str, columns: str) -> str:
    return f"(SELECT {columns}, regexp_extract_all(lower(text), '{WORDS_SQL}') AS toks FROM {table_name})"


@query(
    f"""WITH m AS (SELECT conv_id, turn, list_distinct({sql_shingles('toks')}) AS x FROM {sql_words('conversations', 'conv_id, turn')}), p AS (SELECT conv_id, turn, x, lag(x) OVER ({W}) AS y FROM m)
  SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1::DOUBLE WHEN len(x) = 0 OR len(y) = 0 THEN 0::DOUBLE
    ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)) END, 9) AS jaccard FROM p WHERE y IS NOT NULL"""
)
def shingle_jaccard(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(jaccard(F.col("text"), F.col("before")), 9).alias("jaccard"))


SIMHASH_SQL = (
    "WITH g AS (SELECT doc_id, unnest(" + sql_shingles("toks") + ") AS s FROM " + sql_words("documents", "doc_id") + "), "
    "x AS (SELECT doc_id, ('0x' || substr(sha256(s), 1, 16))::UBIGINT AS h FROM g), "
    "v AS (SELECT doc_id, b, sum(((h >> b) & 1::UBIGINT)::BIGINT) AS n, count(*) AS c FROM x, range(0, 64) r(b) GROUP BY doc_id, b) "
    "SELECT d.doc_id, lower(lpad(to_hex(coalesce(f, 0)), 16, '0')) AS fp FROM documents d LEFT JOIN "
    "(SELECT doc_id, bit_or(CASE WHEN 2 * n > c THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS f FROM v GROUP BY doc_id) USING (doc_id)"
)


@query(SIMHASH_SQL)
def simhash_sha256(spark, sf_dir):
    return dedup.simhash_sha256(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))


@query()
def simhash_blake2b(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", dedup.simhash(F.col("text")).alias("fp"))


@query(f"""WITH fp AS ({SIMHASH_SQL}), p AS (SELECT doc_id, ('0x' || fp)::UBIGINT AS a, lag(('0x' || fp)::UBIGINT) OVER (ORDER BY doc_id) AS b FROM fp)
  SELECT doc_id, bit_count(xor(a, b))::INTEGER AS distance FROM p WHERE b IS NOT NULL AND doc_id % 10 > 0""")
def hamming_pairs(spark, sf_dir):
    """Neighbouring documents of each ten: bits in which their fingerprints differ."""
    fps = dedup.simhash_sha256(docs(spark, sf_dir), "doc_id", "text")
    before = F.lag("fp").over(Window.partitionBy(F.floor(F.col("doc_id") / 10)).orderBy("doc_id"))
    rows = fps.withColumn("before", before).where("before is not null and doc_id % 10 > 0")
    return rows.select("doc_id", hamming(F.col("fp"), F.col("before")).alias("distance"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def exact_dup_docs(spark, sf_dir):
    return dedup.first_equal(docs(spark, sf_dir), "text", "doc_id").select("doc_id", "first_id")


@query()
def near_dup_messages(spark, sf_dir):
    """Messages and the one before them in their conversation, and how alike they are."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", dedup.near_duplicate(F.col("text"), F.col("before")).alias("near"))


BLOCK_RUNS_SQL = rf"""WITH s AS ({BLOCKS_SQL}), b AS (SELECT id, unnest(bs) AS block, generate_subscripts(bs, 1) AS pos FROM (SELECT id, list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)) AS bs FROM s)),
  f AS (SELECT *, CASE WHEN block IS DISTINCT FROM lag(block) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM b WHERE block <> ''),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM f) SELECT id, CAST(run AS BIGINT) AS run, sha256(arg_min(block, pos)) AS digest, count(*) AS times FROM r GROUP BY id, run"""


@query(BLOCK_RUNS_SQL)
def dedup_blocks_exact(spark, sf_dir):
    return dedup.exact_block_runs(block_payloads(spark, sf_dir), "id", "text").select("id", "run", F.sha2("block", 256).alias("digest"), "times")


@query()
def dedup_blocks(spark, sf_dir):
    rows = block_payloads(spark, sf_dir).repartition("id")
    return rows.select("id", F.length("text").alias("before"), F.length(dedup.dedup_blocks(F.col("text"))).alias("after"))


# ---- prose ----


@query(f"SELECT doc_id, length({sql_norm('text')})::BIGINT AS chars, sha256({sql_norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    out = docs(spark, sf_dir).withColumn("t", prose.normalize(F.col("text")))
    return out.select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


RAW_SQL = "SELECT doc_id AS id, text AS t FROM documents"


@query(f"WITH {sql_sentences(RAW_SQL)} SELECT id, idx, sha256(sentence) AS digest, heading FROM s")
def sentence_split(spark, sf_dir):
    rows = prose.sentences(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id", "text")
    return rows.select("id", "idx", F.sha2("sentence", 256).alias("digest"), "heading")


@query(f"WITH {sql_sentences(RAW_SQL)}{SCORES_SQL} SELECT id, idx, round(score, 8) AS score FROM sc")
def sentence_scores(spark, sf_dir):
    rows = prose.scored_sentences(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id", "text")
    return rows.select("id", "idx", F.round("score", 8).alias("score"))


PROSE_SQL = rf"""WITH n AS (SELECT doc_id AS id, {sql_norm('text')} AS t FROM documents), {sql_sentences('SELECT id, t FROM n WHERE length(t) >= 400')}{SCORES_SQL}{KEPT_SQL},
  j AS (SELECT id, {sql_strip(r"regexp_replace(string_agg(sentence, ' ' ORDER BY idx), '(?m)^(\s{0,3}#{1,6}\s.*)$', chr(10) || '\1' || chr(10), 'g')")} AS short FROM kept WHERE kept GROUP BY id),
  o AS (SELECT n.id, CASE WHEN length(j.short) < length(n.t) THEN j.short ELSE n.t END AS out FROM n LEFT JOIN j ON n.id = j.id)"""


@query(PROSE_SQL + " SELECT id, length(out)::BIGINT AS chars, sha256(out) AS digest FROM o")
def prose_compress(spark, sf_dir):
    out = prose.compact_prose(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id", "text")
    return out.select("id", F.length("compacted").cast("long").alias("chars"), F.sha2("compacted", 256).alias("digest"))


# ---- logs ----


def sql_template(x: str) -> str:
    for p, r in [(m[0].replace("(?U)", ""), m[1]) for m in logs.MASKS]:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return sql_strip(x)


SEVERE_SQL = r"(?i)\b(error|fatal|critical|exception|traceback|panic|fail(?:ed|ure)?|warn(?:ing)?)\b"
LOG_LINES_SQL = f"""WITH l AS ({LOGS_SQL}), ln AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT id, string_split(text, chr(10)) AS ls FROM l)),
  q AS (SELECT id, pos, line, {sql_template('line')} AS template, count(*) OVER (PARTITION BY id) AS n,
    bool_or(regexp_matches(line, '{SEVERE_SQL}')) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ln),
  f AS (SELECT id, pos, line, template, n, near OR pos < 5 OR pos >= n - 5 AS forced FROM q)"""
LOG_RUNS_SQL = (
    LOG_LINES_SQL
    + """, br AS (SELECT *, CASE WHEN forced OR coalesce(lag(forced) OVER v, true) OR template <> lag(template) OVER v THEN 1 ELSE 0 END AS fresh FROM f WINDOW v AS (PARTITION BY id ORDER BY pos)),
  rn AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM br),
  ru AS (SELECT id, run, min(pos) AS pos, arg_min(line, pos) AS line, count(*) AS times, max(n) AS n FROM rn GROUP BY id, run),
  ou AS (SELECT id, string_agg(CASE WHEN times = 1 THEN line ELSE line || '    [× ' || times::VARCHAR || ' similar lines]' END, chr(10) ORDER BY pos) AS short FROM ru WHERE n >= 8 GROUP BY id)"""
)


@query(LOG_LINES_SQL + " SELECT template, count(*) AS n FROM f GROUP BY template")
def log_templates(spark, sf_dir):
    return logs.log_lines(log_payloads(spark, sf_dir), "id", "text").groupBy("template").agg(F.count("*").alias("n"))


@query(LOG_LINES_SQL + " SELECT id, pos::INTEGER AS pos, forced FROM f")
def log_forced_lines(spark, sf_dir):
    return logs.log_lines(log_payloads(spark, sf_dir), "id", "text").select("id", "pos", "forced")


@query(LOG_RUNS_SQL + " SELECT l.id, sha256(CASE WHEN length(short) < length(text) THEN short ELSE text END) AS digest, length(CASE WHEN length(short) < length(text) THEN short ELSE text END)::BIGINT AS chars FROM l LEFT JOIN ou ON l.id = ou.id")
def log_compress(spark, sf_dir):
    out = logs.compact_logs(log_payloads(spark, sf_dir), "id", "text")
    return out.select("id", F.sha2("compacted", 256).alias("digest"), F.length("compacted").cast("long").alias("chars"))


# ---- code ----

CODE_OUT_SQL = rf"""WITH c AS ({CODE_SQL}), ln AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT id, string_split(text, chr(10)) AS ls FROM c)),
  k AS (SELECT id, pos, line, length(line) - length(ltrim(line)) AS pad, regexp_matches(line, '^\s*(?:export\s+)?(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:def |class |interface |struct |enum |func |function |fn |impl |trait |type |const |let |var |import |from |#include|package |namespace )')
    OR regexp_matches(line, '^\s*(?://|#|/\*|\*)') OR trim(line) IN ('}}', '}};', ')', '}});') OR (length(line) - length(ltrim(line)) <= 4 AND trim(line) <> '') AS keep FROM ln),
  g AS (SELECT *, coalesce(lag(keep) OVER (PARTITION BY id ORDER BY pos), true) AS prev FROM k),
  o AS (SELECT id, string_agg(CASE WHEN keep THEN line ELSE repeat(' ', pad) || '// …' END, chr(10) ORDER BY pos) AS short FROM g WHERE keep OR prev GROUP BY id)
  SELECT c.id, sha256(CASE WHEN length(short) < length(text) THEN short ELSE text END) AS digest FROM c JOIN o ON c.id = o.id"""


@query(CODE_OUT_SQL)
def generic_skeleton(spark, sf_dir):
    return code_payloads(spark, sf_dir).repartition("id").select("id", F.sha2(code.generic_skeleton(F.col("text")), 256).alias("digest"))


@query()
def python_skeleton(spark, sf_dir):
    p = table(spark, sf_dir, "part").repartition("p_partkey")
    source = F.concat(
        F.lit("import os\n\nclass P"), F.col("p_partkey").cast("string"), F.lit(':\n    """'), "p_name", F.lit('"""\n\n    def size(self):\n        x = '), F.col("p_size").cast("string"),
        F.lit("\n        return x\n\n    def brand(self):\n        return '"), "p_brand", F.lit("'\n\nTYPE = '"), "p_type", F.lit("'\n"),
    )
    out = code.compact_code(p.select(F.col("p_partkey").alias("id"), source.alias("text")), "text")
    return out.select("id", F.length("text").alias("before"), F.length("compacted").alias("after"), F.sha2("compacted", 256).alias("digest"))


# ---- JSON ----

FIELDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("priority", T.StringType())])


@query(f"""WITH j AS ({JSON_SQL}) SELECT id, json_array_length(text)::INTEGER AS n, json_array_length(text)::INTEGER AS records, json_array_length(text) >= 4 AS is_record_array,
  array_to_string(list_transform(json_keys(text, '$[0]'), lambda k: k || ':' || CASE json_type(text, '$[0].' || k) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'str' ELSE 'float' END), ', ') AS keys FROM j""")
def json_record_summary(spark, sf_dir):
    return records.record_summary(json_payloads(spark, sf_dir), "id", "text", FIELDS)


@query(f"""WITH j AS ({JSON_SQL}) SELECT id, length(o)::BIGINT AS chars, sha256(o) AS digest FROM (SELECT id, '{{"__condensed_records__":' || json_array_length(text)::VARCHAR || ',"keys":"id:int, status:str, priority:str","samples":['
  || (json_extract(text, '$[0]'))::VARCHAR || ',' || (json_extract(text, '$[1]'))::VARCHAR || '],"elided":' || (json_array_length(text) - 2)::VARCHAR || '}}' AS o FROM j)""")
def json_crush(spark, sf_dir):
    out = records.compact_json(json_payloads(spark, sf_dir), "text")
    return out.select("id", F.length("compacted").cast("long").alias("chars"), F.sha2("compacted", 256).alias("digest"))


# ---- passages ----

RAG_SQL = r"""WITH ct AS (SELECT doc_id AS c, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''_-]+'), lambda x: lower(x))) AS t FROM documents),
  qt AS (SELECT item_id AS q, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''_-]+'), lambda x: lower(x))) AS t FROM benchmark),
  ctf AS (SELECT c, t, count(*)::DOUBLE / any_value(l) AS tf FROM (SELECT c, t, count(*) OVER (PARTITION BY c) AS l FROM ct) GROUP BY c, t),
  qf AS (SELECT q, t, count(*)::DOUBLE / any_value(l) AS qtf FROM (SELECT q, t, count(*) OVER (PARTITION BY q) AS l FROM qt) GROUP BY q, t),
  df AS (SELECT t, count(*) AS df FROM ctf GROUP BY t), nd AS (SELECT count(*) AS n FROM documents),
  cw AS (SELECT c, ctf.t, tf * (ln((n + 2)::DOUBLE / (df + 1)) + 1) AS w0, tf * (ln((n + 2)::DOUBLE / (df + 2)) + 1) AS w1 FROM ctf JOIN df ON ctf.t = df.t, nd),
  qw AS (SELECT q, qf.t, qtf * (ln((n + 2)::DOUBLE / (coalesce(df, 0) + 2)) + 1) AS qw FROM qf LEFT JOIN df ON qf.t = df.t, nd),
  qn AS (SELECT q, sum(qw * qw) AS qn FROM qw GROUP BY q), cn AS (SELECT c, sum(w0 * w0) AS cn FROM cw GROUP BY c),
  pr AS (SELECT q, c, sum(qw * w1) AS dot, sum(w1 * w1 - w0 * w0) AS more FROM qw JOIN cw ON qw.t = cw.t GROUP BY q, c),
  csc AS (SELECT pr.q, pr.c, round(dot / (sqrt(cn + more) * sqrt(qn)), 9) AS score FROM pr JOIN cn ON pr.c = cn.c JOIN qn ON pr.q = qn.q),
  crk AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rk FROM csc WHERE score > 0)"""


def _passages(spark, sf_dir):
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_idx"), F.col("text").alias("chunk"))
    return chunks, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(RAG_SQL + " SELECT t AS term, df FROM df")
def tfidf_terms(spark, sf_dir):
    return rag.term_weights(_passages(spark, sf_dir)[0], "chunk_idx", "chunk").groupBy("term").agg(F.max("df").alias("df"))


@query(RAG_SQL + " SELECT q AS query_id, c AS chunk_idx, round(score, 8) AS score, rk::INTEGER AS rk FROM crk WHERE rk <= 10")
def rag_rank(spark, sf_dir):
    return rag.rank(*_passages(spark, sf_dir), k=10).select("query_id", "chunk_idx", F.round("score", 8).alias("score"), "rk")


@query(PROSE_SQL + ", " + RAG_SQL[5:] + " SELECT q AS query_id, c AS chunk_idx, sha256(o.out) AS digest FROM crk JOIN o ON crk.c = o.id WHERE crk.rk <= 10")
def rag_keep(spark, sf_dir):
    out = rag.compact_passages(*_passages(spark, sf_dir), max_chunks=10)
    return out.select("query_id", "chunk_idx", F.sha2("compacted", 256).alias("digest"))


# ---- whole pipelines ----


def _digest(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "kind", "original_tokens", "compressed_tokens", "saved_tokens", F.round("fidelity", 6).alias("fidelity"), "ref", "reverted", "secrets", F.sha2("text", 256).alias("digest"))


@query()
def compact_documents(spark, sf_dir):
    return _digest(compact(docs(spark, sf_dir), "doc_id", "text"), "doc_id")


@query()
def compact_mixed_payloads(spark, sf_dir):
    """Payloads of every kind in one run."""
    every = None
    for name, f in (("log", log_payloads), ("json", json_payloads), ("code", code_payloads)):
        part = f(spark, sf_dir).select(F.concat(F.lit(f"{name}-"), F.col("id").cast("string")).alias("id"), "text")
        every = part if every is None else every.union(part)
    return _digest(compact(every, "id", "text", Options(min_tokens=0)), "id")


@query()
def compact_conversations(spark, sf_dir):
    out = conv.compact_conversations(_repasted(spark, sf_dir))
    return out.select("conv_id", "turn", "action", "dup", "ref", F.sha2("text", 256).alias("digest"))


def _repasted(spark, sf_dir):
    """Conversations in which the longest message comes once more, with four short turns after it."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", F.struct(F.length("text"), "turn")).alias("text"))
    again = last.select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"), "last", "text")
    again = again.select("conv_id", (F.col("last") + F.col("i")).alias("turn"), F.lit("user").alias("role"), F.when(F.col("i") == 1, F.concat(F.lit("again: "), "text")).otherwise("ok").alias("text"))
    return t.union(again)


@query("SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, role = 'system' OR pos >= n - 4 OR length(text) = 0 AS protected FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def protected_tail(spark, sf_dir):
    return conv.positions(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "pos", "protected")


EXACT_DUP_SQL = """WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM (SELECT conv_id, turn, text FROM conversations UNION ALL
  SELECT conv_id, turn + 100, text FROM conversations))
  SELECT conv_id, turn, CAST(min(pos) OVER (PARTITION BY conv_id, text) AS INTEGER) AS first_pos FROM p"""


@query(EXACT_DUP_SQL)
def exact_repeats(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = t.union(t.select("conv_id", F.col("turn") + 100, "text")).withColumn("role", F.lit("user"))
    return conv.positions(t, 0).select("conv_id", "turn", F.min("pos").over(Window.partitionBy("conv_id", "text")).alias("first_pos"))


# ---- store ----

@query("SELECT doc_id, substr(sha256(text), 1, 12) AS ref FROM documents")
def store_refs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", reference_of(F.col("text")).alias("ref"))


def _entries(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select(reference_of(F.col("text")).alias("ref"), F.col("text").alias("content"), F.lit("conversation").alias("kind"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600).alias("created_at"))


@query("SELECT conv_id, turn, substr(sha256(text), 1, 12) AS ref, length(text)::INTEGER AS chars FROM conversations")
def retrieve_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    asked = t.select("conv_id", "turn", F.concat(F.lit("short\n[brevia:ref "), reference_of(F.col("text")), F.lit(" +12 tokens — retrieve to expand]")).alias("asked"))
    out = store.retrieve(asked, "asked", _entries(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_000_000)), 0)
    return out.select("conv_id", "turn", "ref", F.length("content").alias("chars"))


@query("SELECT ref FROM (SELECT substr(sha256(text), 1, 12) AS ref, max(turn) AS t FROM conversations GROUP BY 1) WHERE 10 * 3600 - t * 3600 <= 7 * 3600")
def store_expiry(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 10 * 3600))
    return store.alive(store.latest(_entries(spark, sf_dir)), now, 7 * 3600).select("ref")


# ---- whole results of kinds that SQL can follow from end to end, and telemetry over them ----

JSON_OUT_SQL = f"""SELECT id, text, '{{"__condensed_records__":' || json_array_length(text)::VARCHAR || ',"keys":"id:int, status:str, priority:str","samples":['
  || (json_extract(text, '$[0]'))::VARCHAR || ',' || (json_extract(text, '$[1]'))::VARCHAR || '],"elided":' || (json_array_length(text) - 2)::VARCHAR || '}}' AS out FROM ({JSON_SQL})"""
RESULTS_SQL = f"""{LOG_RUNS_SQL}, res AS (SELECT 'log-' || l.id::VARCHAR AS id, 'log' AS kind, text, CASE WHEN length(short) < length(text) THEN short ELSE text END AS out FROM l LEFT JOIN ou ON l.id = ou.id
    UNION ALL SELECT 'json-' || id::VARCHAR, 'json', text, out FROM ({JSON_OUT_SQL})),
  tt AS (SELECT id, unnest({sql_telling('text')}) AS tok, 1 AS o, 0 AS c FROM res UNION ALL SELECT id, unnest({sql_telling('out')}), 0, 1 FROM res),
  tg AS (SELECT id, tok, sum(o) AS o, sum(c) AS c FROM tt GROUP BY id, tok), tf AS (SELECT id, sum(least(o, c))::DOUBLE / sum(o) AS fidelity FROM tg GROUP BY id HAVING sum(o) > 0),
  g1 AS (SELECT res.*, coalesce(tf.fidelity, 1) AS fidelity, {sql_tokens('text')} AS a, greatest(0, {sql_tokens('text')} - {sql_tokens('out')}) AS gain FROM res LEFT JOIN tf ON res.id = tf.id),
  g2 AS (SELECT *, CASE WHEN gain > 0 AND out <> text THEN substr(sha256(text), 1, 12) END AS ref FROM g1),
  g3 AS (SELECT *, CASE WHEN ref IS NULL THEN out ELSE out || chr(10) || '[brevia:ref ' || ref || ' +' || gain::VARCHAR || ' tokens — retrieve to expand]' END AS final FROM g2),
  g AS (SELECT *, {sql_tokens('final')} AS b FROM g3)"""


def _results(spark, sf_dir):
    """What compact() makes of logs and JSON."""
    parts = [f(spark, sf_dir).select(F.concat(F.lit(f"{name}-"), F.col("id").cast("string")).alias("id"), "text") for name, f in (("log", log_payloads), ("json", json_payloads))]
    return compact(parts[0].union(parts[1]), "id", "text", Options(min_tokens=0))


@query(RESULTS_SQL + """ SELECT id, kind, a AS original_tokens, b AS compressed_tokens, greatest(0, a - b) AS saved_tokens, round(fidelity, 6) AS fidelity, ref, false AS reverted, 0::BIGINT AS secrets, sha256(final) AS digest FROM g""")
def compact_logs_and_json(spark, sf_dir):
    return _digest(_results(spark, sf_dir), "id")


@query(RESULTS_SQL + """ SELECT 3::BIGINT AS calls, count(*) AS blocks, CAST(sum(a) AS BIGINT) AS original_tokens, CAST(sum(b) AS BIGINT) AS compressed_tokens, CAST(greatest(0, sum(a) - sum(b)) AS BIGINT) AS saved_tokens,
  round_even((1 - sum(b)::DOUBLE / sum(a)) * 100, 1) AS reduction_pct, round_even(sum(greatest(0, a - b) / 1e6::DOUBLE * 2.5::DOUBLE), 4) AS cost_saved_usd, round_even(avg(fidelity), 3) AS avg_fidelity, 0::BIGINT AS reverted_low_quality, 0::BIGINT AS secrets_redacted FROM g""")
def telemetry(spark, sf_dir):
    return report.telemetry(_results(spark, sf_dir), 3)


@query(RESULTS_SQL + " SELECT kind, CAST(sum(a - b) AS BIGINT) AS saved FROM g GROUP BY kind")
def savings_by_kind(spark, sf_dir):
    return report.savings_by_kind(_results(spark, sf_dir))


@query(RESULTS_SQL + """ SELECT CASE WHEN grouping(kind) = 1 THEN 'TOTAL' ELSE kind END AS kind, CAST(sum(a) AS BIGINT) AS before, CAST(sum(b) AS BIGINT) AS after, round((1 - sum(b)::DOUBLE / sum(a)) * 100, 9) AS saved_pct,
  NULL::DOUBLE AS quality, round((sum(a) - sum(b)) / 1e6::DOUBLE * 2.5::DOUBLE, 9) AS usd_saved, round((sum(a) - sum(b)) / 1e6::DOUBLE * 2.5::DOUBLE * 10000, 9) AS usd_day, round((sum(a) - sum(b)) / 1e6::DOUBLE * 2.5::DOUBLE * 10000 * 30, 9) AS usd_month
  FROM g GROUP BY ROLLUP (kind)""")
def perf_rollup(spark, sf_dir):
    return report.perf_report(_results(spark, sf_dir))


# ---- services ----


@query("""SELECT conv_id, sha256('{"messages": ' || string_agg(role || ':' || text, '|' ORDER BY turn) || ', "model": standard, "response_format": null, "temperature": 0, "tool_choice": null, "tools": null, "top_p": null}') AS key FROM conversations GROUP BY conv_id""")
def response_cache_keys(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("m"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x.m), "|").alias("messages"))
    return rows.select("conv_id", services.request_key({"messages": F.col("messages"), "model": F.lit("standard"), "temperature": F.lit("0")}).alias("key"))


@query("""SELECT u.user_id AS key, CAST(coalesce(b, -1) AS BIGINT) AS cached, b IS NOT NULL AS hit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN
  (SELECT user_id, arg_max(event_id, ts) AS b FROM events WHERE epoch((SELECT max(ts) FROM events)) // 1 - epoch(ts) // 1 <= 86400 GROUP BY user_id) e ON u.user_id = e.user_id""")
def response_cache_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    cache = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("body"), F.col("ts").alias("created_at"))
    return services.cache_lookup(e.select(F.col("user_id").alias("key")).distinct(), cache, now, 86_400).withColumn("cached", F.coalesce("cached", F.lit(-1)))


@query("SELECT event_id AS key FROM events ORDER BY ts DESC, event_id LIMIT 1024")
def response_cache_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("created_at"))
    return services.cache_capped(e).select("key")


@query()
def tool_replies(spark, sf_dir):
    out = services.tool_reply(log_payloads(spark, sf_dir), "id", "text", "aggressive")
    return out.select("id", F.length("reply").alias("chars"), F.sha2("reply", 256).alias("digest"))


@query(f"SELECT conv_id, CAST(greatest(0, sum(a) - sum(b)) AS BIGINT) AS saved FROM (SELECT conv_id, {sql_tokens('text')} AS a, {sql_tokens(sql_norm('text'))} AS b FROM conversations) GROUP BY conv_id")
def request_tokens_saved(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    rows = t.groupBy("conv_id").agg(F.sum(token_count(F.col("text"))).alias("a"), F.sum(token_count(prose.normalize(F.col("text")))).alias("b"))
    return rows.select("conv_id", services.tokens_saved(F.col("a"), F.col("b")).alias("saved"))


# ---- messages of parts ----


@query("SELECT conv_id, turn, role || chr(10) || text AS text, 'image' || chr(10) || role || chr(10) || text AS every, 2::BIGINT AS parts FROM conversations")
def message_parts(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("parts", F.array(part("image", F.lit("image")), part("text", F.col("role")), part("text", F.col("text"))))
    new = conv.replace_parts_text(F.col("parts"), F.lit("new"))
    kept = F.size(F.filter(new, lambda p: p.text != "new")).cast("long")
    return rows.select("conv_id", "turn", conv.parts_text(F.col("parts")).alias("text"), conv.all_parts_text(F.col("parts")).alias("every"), kept.alias("parts"))


# ---- streams, over the batch form of the same plan ----


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum({sql_tokens('props')}) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def stream_rollup(spark, sf_dir):
    return windowed_tokens(table(spark, sf_dir, "events"))


def sql_lookup(ttl: int) -> str:
    """What each event that isn't a purchase finds of its user's last purchase, if that is no older than ttl seconds."""
    last = "OVER (PARTITION BY user_id ORDER BY ts, body IS NULL, event_id ROWS UNBOUNDED PRECEDING)"
    return f"""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN coalesce(props, '') END AS body FROM events),
  l AS (SELECT *, last_value(body IGNORE NULLS) {last} AS b, last_value(CASE WHEN body IS NOT NULL THEN ts END IGNORE NULLS) {last} AS t FROM e),
  f AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(t) <= {ttl * 1_000_000} THEN b END AS found FROM l WHERE body IS NULL)
  SELECT event_id AS id, user_id::VARCHAR AS key, found, found IS NOT NULL AS hit FROM f"""


def lookup_events(spark, sf_dir):
    body = F.when(F.col("event_type") == "purchase", F.coalesce("props", F.lit("")))
    return streamed(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))


@query(sql_lookup(86_400))
def stream_store_entries(spark, sf_dir):
    found = keyed.drained(keyed.stored_entries(lookup_events(spark, sf_dir), ttl=86_400))
    return found.select("id", "key", "found", "hit")


@query(sql_lookup(3600))
def stream_response_cache(spark, sf_dir):
    found = keyed.drained(keyed.cached_responses(lookup_events(spark, sf_dir), ttl=3600, most=1_000_000, slots=64))
    return found.select("id", "key", "found", "hit")


@query(f"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM (SELECT conv_id, turn, text FROM conversations UNION ALL
    SELECT conv_id, turn + 100, text FROM conversations)),
  f AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, text) AS first FROM p)
  SELECT conv_id, turn, pos, CASE WHEN length(text) > {conv.REPEAT_LENGTH} AND first < pos THEN first ELSE -1 END AS dup FROM f""")
def stream_conversation_repeats(spark, sf_dir):
    turns = streamed(spark, sf_dir, "conversations").withColumn("role", F.lit("user"))
    turns = turns.withColumn("turn", F.explode(F.array("turn", F.col("turn") + 100))).withColumn("ts", F.timestamp_seconds(F.col("turn") + 1))
    return keyed.drained(keyed.repeats_so_far(turns, threshold=1.0)).fillna(-1, ["dup"])
