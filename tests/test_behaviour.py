"""What compaction promises, on small payloads of each kind."""

import difflib
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brevia.functions.redact import redact
from brevia.functions.route import detect
from brevia.functions.text import jaccard, lines, shingles, words
from brevia.functions.tokens import count_tokens, price_per_mtok, token_count, with_price
from brevia.operators import code, dedup, logs, prose, records
from brevia.operators.fidelity import TELLING, fidelity
from brevia.options import Options
from brevia.plans import conversations as conv
from brevia.plans.pipeline import compact, store_rows
from brevia.plans.report import perf_report, telemetry
from brevia.sources.store import Store, retrieve

LOG = "\n".join([f"2024-01-02T10:00:{i:02d} INFO beat shard={i % 4} ok" for i in range(40)] + ["2024-01-02T10:01:00 ERROR db refused"] + [f"2024-01-02T10:02:{i:02d} INFO beat shard=1 ok" for i in range(40)])
JSON = json.dumps([{"id": i, "status": "ok", "v": i * 2} for i in range(100)])
CODE = 'import os\n\nclass A:\n    """Does it."""\n\n    def f(self, x):\n        y = x + 1\n        return y * 2\n\n    def g(self):\n        return 3\n\ndef h():\n    """Top."""\n    total = 0\n    for i in range(10):\n        total += i\n    return total\n'
PROSE = "The release was blocked by an error in the ledger service. " + " ".join(f"Filler sentence number {i} says nothing much at all here." for i in range(20))
DIFF = "diff --git a/x b/x\n@@ -1 +1 @@\n-old\n+new\n"


def one(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r[0] for r in df.select("id", fn(F.col("text")).alias("x")).orderBy("id").select("x").collect()]


def test_routes(spark):
    got = one(spark, detect, '[{"a": 1}]', '{"a": 1}', '{"a": 1}\nnot json', '{"a": ', CODE, LOG, DIFF, PROSE, "", None, "a|b|c\n1|2|3\n4|5|6", "   \n")
    assert got == ["json", "json", "json", "text", "code", "log", "diff", "text", "text", "text", "table", "text"]


def test_tokens_round_half_to_even(spark):
    assert one(spark, token_count, "", None, "ab", "a" * 10, "a" * 14, "a b c d e f", "é½aʼ") == [0, 0, 1, 2, 4, 4, 1]


def test_prices(spark):
    got = spark.range(1).select(price_per_mtok(F.lit(" PREMIUM ")), price_per_mtok(F.lit("x")), price_per_mtok(F.lit("x"), 9.0), price_per_mtok(F.lit("x"), None, with_price({}, " X ", 1))).first()
    assert list(got) == [15.0, 2.5, 9.0, 1.0]


def test_redaction(spark):
    key, jwt = "sk-" + "a1" * 12, ".".join(["eyJ" + "a" * 12, "b" * 12, "c" * 12])
    df = spark.createDataFrame([(1, f"use {key} now"), (2, f"token={key}"), (3, 'api_key: "abcdef"'), (4, f"x {jwt}"), (5, "nothing"), (6, None)], "id long, text string")
    got = {r["id"]: (r["redacted"], r["secrets"]) for r in redact(df).collect()}
    assert got[1] == ("use <redacted:openai_key> now", 1)
    assert got[2] == ("token=<redacted:assignment_secret>", 2)
    assert got[3] == ("api_key=<redacted:assignment_secret>", 1)
    assert got[4] == ("x <redacted:jwt>", 1)
    assert got[5] == ("nothing", 0) and got[6] == ("", 0)


def plain_fidelity(a, b):
    """The same measure, told with Python's own regular expressions."""
    def tokens(t):
        return Counter(m.lower() for p in TELLING for m in re.findall(("(?i)" if p.startswith("(?iU)") else "") + p.split(")", 1)[1], t))

    x, y = tokens(a), tokens(b)
    return sum(min(n, y[t]) for t, n in x.items()) / sum(x.values()) if x else float(bool(b.strip()))


def test_fidelity_on_any_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("half", F.expr("substring(text, 1, length(text) div 2)"))
    extra = spark.createDataFrame([(-1, "plain words", "x"), (-2, "plain words", " "), (-3, "", "")], "doc_id long, text string, half string")
    for r in fidelity(docs.union(extra), "doc_id", "text", "half").collect():
        assert r["fidelity"] == pytest.approx(plain_fidelity(r["text"], r["half"]), abs=1e-9), r["doc_id"]


def test_lines_and_shingles(spark):
    assert one(spark, lines, "a\r\nb\rc\n", "", "\n", "a\x0bb\u2028c") == ["a\r\nb\rc\n".splitlines(), [], [""], "a\x0bb\u2028c".splitlines()]
    assert one(spark, lambda c: shingles(words(c)), "a b c d", "A b", "") == [["a b c", "b c d"], ["a b"], []]
    df = spark.createDataFrame([("a b c d", "a b c d"), ("", ""), ("a", "")], "a string, b string")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]


def test_similarity_keeps_the_order_of_arguments():
    u = "abcd" * 100
    assert dedup.similarity(u, u) == 1.0 and dedup.similarity("", "a") == 0.0 and dedup.similarity("a" * 10, "a" * 3) == 0.0
    m = difflib.SequenceMatcher(None, "Z" + u, u + "Z")
    assert dedup.similarity("Z" + u, u + "Z") == (m.quick_ratio() if m.quick_ratio() < 0.6 else m.ratio())


def test_blocks_collapse(spark):
    trace = "Traceback: boom at line 10 in module alpha, retrying the call"
    text = "\n\n".join([trace] * 6 + ["the end"])
    short = one(spark, dedup.dedup_blocks, text, "one\n\ntwo", None)
    assert short[0].count("Traceback") == 1 and "[× 6 near-identical blocks collapsed]" in short[0]
    assert short[1:] == ["one\n\ntwo", ""]


def test_runs_of_blocks_are_those_of_sql(spark, tmp_path):
    """Blocks that begin or end with their own place, with spaces of all kinds, and gaps that are none."""
    import oracle

    from brevia import queries as engine

    texts = ["a 0", "0 first\nends in 1\n2 and 22\n2 and 22\n33", "same\n  same \nsame\xa0\n\u2003same\u3000 \n\tsame\nsame\x0b", "x\n\x0b\ny\n\f\ny\n \r\ny", "", " \xa0", None, "\n\n1\n\n1\n\n", "10\n11\n12\n" * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = engine.QUERIES["dedup_blocks_exact"](spark, str(tmp_path)).toPandas()
    assert oracle.difference(got, oracle.connect(str(tmp_path)).execute(engine.ORACLES["dedup_blocks_exact"]).df()) == ""


def test_simhash_brute(spark):
    import hashlib

    def brute(text):
        t = re.findall(r"\w+", text.lower())
        s = [" ".join(t[i : i + 3]) for i in range(len(t) - 2)] if len(t) >= 3 else [" ".join(t)] if t else []
        v = [0] * 64
        for g in s:
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
            for i in range(64):
                v[i] += 1 if h >> i & 1 else -1
        return sum(1 << i for i in range(64) if v[i] > 0)

    texts = [PROSE, LOG, "two words", ""]
    assert [x % (1 << 64) for x in one(spark, dedup.simhash, *texts)] == [brute(t) for t in texts]


def compacted(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r["compacted"] for r in fn(df).orderBy("id").collect()]


def test_logs(spark):
    out, short = compacted(spark, lambda d: logs.compact_logs(d, "id", "text"), LOG, "a\nb")
    assert "ERROR db refused" in out and "similar lines]" in out and len(out) < len(LOG) and short == "a\nb"


def test_prose(spark):
    out, short, head, none = compacted(spark, lambda d: prose.compact_prose(d, "id", "text"), PROSE, "**short** text", "# Title here\n\n" + PROSE, "1 2 3. " * 100)
    assert len(out) < len(PROSE) and all(s in PROSE for s in out.split('. ')) and short == "short text"
    assert "# Title here" in head and none.startswith("1 2 3.")


def test_code(spark):
    out, bad, braces = compacted(spark, lambda d: code.compact_code(d, "text"), CODE, "def f(:\n" + "        x = 1\n" * 9, "function f() {\n" + "        step();\n" * 9 + "}\n{}{}{}")
    assert "def f(self, x):" in out and "body elided" in out and "# … 2 methods" in out and "total" not in out
    assert bad.startswith("def f(:\n        // …") and braces.count("// …") == 1


def test_json(spark):
    long_ = json.dumps({"s": "x" * 300, "n": list(range(20)), "k": [1, 2]})
    rows = "\n".join(json.dumps({"a": i}) for i in range(6))
    out, bad, clipped, jsonl, exact = compacted(spark, lambda d: records.compact_json(d, "text"), JSON, '{"a": ', long_, rows, json.dumps("y" * 280))
    got = json.loads(out)
    assert got["__condensed_records__"] == 100 and got["keys"] == "id:int, status:str, v:int" and len(got["samples"]) == 2 and got["elided"] == 98
    assert bad == '{"a":' and json.loads(clipped)["s"].endswith("…(+40 chars)") and json.loads(clipped)["n"] == [0, 1, 2, 3, "…(+14 more items)", 18, 19]
    assert json.loads(jsonl)["__condensed_records__"] == 6 and json.loads(exact) == "y" * 280


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([("json", JSON), ("log", LOG), ("code", CODE * 3), ("text", PROSE), ("diff", DIFF), ("empty", None)], "id string, text string")
    return compact(df, "id", "text", Options(min_tokens=0)).cache()


def test_pipeline(results):
    by = {r["id"]: r for r in results.collect()}
    assert {k: r["kind"] for k, r in by.items()} == {"json": "json", "log": "log", "code": "code", "text": "text", "diff": "diff", "empty": "text"}
    for k in ("json", "log", "code"):
        assert by[k]["reversible"] and by[k]["saved_tokens"] > 0 and by[k]["ref"] in by[k]["text"]
    assert by["empty"]["text"] == "" and by["empty"]["original_tokens"] == 0
    assert all(0 <= r["fidelity"] <= 1 for r in by.values())


def test_gate_and_passthrough(spark):
    facts = "Alice paid 100 to Bob_1. Carol paid 200 to Dave_2. Erin paid 300 to Frank_3. Grace paid 400 to Heidi_4. " * 6
    df = spark.createDataFrame([(1, facts)], "id long, text string")
    back = compact(df, options=Options(min_tokens=0, quality_threshold=0.99)).first()
    assert back["reverted"] and back["text"] == facts and back["saved_tokens"] == 0
    assert compact(df, options=Options(min_tokens=10_000)).first()["kind"] == "passthrough"
    assert compact(df, options=Options(enabled=False)).first()["text"] == facts
    secret = spark.createDataFrame([(1, "password = hunter22")], "id long, text string")
    assert compact(secret).first()["text"] == "password = hunter22"
    assert compact(secret, options=Options(redact_outputs=True)).first()["text"] == "password=<redacted:assignment_secret>"
    assert compact(df.withColumn("k", F.lit("log")), options=Options(min_tokens=0), forced_kind="k").first()["kind"] == "log"


def test_round_trip_and_expiry(spark, results, tmp_path):
    store = Store(spark, str(tmp_path / "store"), ttl=10)
    store.put(store_rows(results, F.timestamp_seconds(F.lit(1000))))
    asked = results.where("ref is not null").select("id", F.col("text").alias("asked"), "original")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    assert all(r["content"] == r["original"] for r in store.get(asked, "asked", at(1005)).collect())
    assert all(r["content"] is None for r in retrieve(asked, "ref2", store.entries(), at(1100), 10).collect()) if "ref2" in asked.columns else True
    assert store.get(asked, "asked", at(1100)).where("content is not null").count() == 0
    n = store.entries().count()
    assert store.rewrite(str(tmp_path / "kept"), now=at(1005), without=store.entries().limit(1)) == 1 and n > 1


def test_report(results):
    t = telemetry(results, 2).first()
    assert t["calls"] == 2 and t["blocks"] == 6 and t["saved_tokens"] == t["original_tokens"] - t["compressed_tokens"] > 0
    rows = {r["kind"]: r for r in perf_report(results).collect()}
    assert rows["TOTAL"]["before"] == t["original_tokens"] and rows["TOTAL"]["usd_day"] == pytest.approx(rows["TOTAL"]["usd_saved"] * 10_000)


def test_conversations(spark):
    paste = "def handler(event): " + "value = event['amount'] * 3; " * 20
    turns = ["You are helpful.", paste, "thanks, and this?", "again: " + paste, LOG, "a", "b", "c", "d"]
    roles = ["system", "user", "assistant", "user", "tool", "user", "assistant", "user", "assistant"]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(roles, turns, strict=True))], "conv_id long, turn long, role string, text string")
    rows = conv.compact_conversations(df, 4, Options(min_tokens=50)).orderBy("turn").collect()
    assert [r["action"] for r in rows][:5] == ["kept", "kept", "kept", "pointer", "compacted"] or rows[1]["action"] == "compacted"
    assert rows[3]["dup"] == 1 and "identical to message #1" in rows[3]["text"] and [r["text"] for r in rows[5:]] == turns[5:]


def test_streams(spark, tmp_path):
    from brevia.streaming.stateful import distinct_payloads, windowed_tokens

    rows = [(i, f"2024-01-01 00:{i:02d}:00", "click", "{\"k\": 1}") for i in range(30)]
    spark.createDataFrame(rows, "id long, s string, event_type string, props string").selectExpr("id", "timestamp(s) ts", "event_type", "props").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windowed_tokens(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 30
    q = distinct_payloads(stream, "ts", "props").writeStream.outputMode("append").format("memory").queryName("d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("d").count() == 1


def test_exact_token_counts(spark):
    import public_tokenizers
    import tiktoken  # noqa: F401

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert one(spark, lambda c: count_tokens(c, "bpe", path), "hello world", "", None) == [2, 0, 0]
    assert one(spark, lambda c: count_tokens(c, "bpe", "/no/such/file"), "abcdefgh") == [2]


def test_options():
    o = Options.from_env({"BREVIA_LEVEL": "light", "BREVIA_MIN_TOKENS": "x", "BREVIA_DEDUP": "off", "BREVIA_STORE_TTL": "5"})
    assert (o.keep_ratio, o.min_tokens, o.dedup, o.store_ttl) == (0.70, 300, False, 5)
    assert o.merged(level=None, model="economy").level == "light" and Options(level="odd").keep_ratio == 0.45
