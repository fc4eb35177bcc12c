"""The command line, run in this process, and what it stands on: exact token counts and passages."""

import json
import sys

from pyspark.sql import functions as F

from brevia import cli
from brevia.operators import rag
from brevia.options import Options
from brevia.plans.pipeline import compact, register

LOG = "\n".join(f"2024-01-02T10:00:{i % 60:02d} INFO beat shard={i % 4} ok" for i in range(120))


def test_compact_stats_and_retrieve(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("BREVIA_STORE_DIR", str(tmp_path / "store"))
    (tmp_path / "a.log").write_text(LOG)
    assert cli.main(["compact", str(tmp_path / "a.log")]) == 0
    shown = capsys.readouterr()
    assert len(shown.out) < len(LOG) and "kind=log" in shown.err
    ref = shown.out.split("[brevia:ref ")[1].split()[0]
    assert cli.main(["retrieve", ref]) == 0 and capsys.readouterr().out.rstrip("\n") == LOG
    assert cli.main(["retrieve", "0" * 12]) == 1 and "no entry" in capsys.readouterr().err
    assert cli.main(["compact", str(tmp_path / "a.log"), "--out", str(tmp_path / "out")]) == 0
    assert cli.main(["stats", str(tmp_path / "out")]) == 0
    row = json.loads(capsys.readouterr().out)
    assert row["blocks"] == 1 and row["saved_tokens"] > 0 and row["by_kind"]["log"] > 0


def test_standard_input_perf_doctor_and_help(spark, monkeypatch, capsys, tmp_path):
    monkeypatch.setenv("BREVIA_STORE_DIR", str(tmp_path / "store"))

    class Typed:
        def read(self):
            return LOG

    monkeypatch.setattr(sys, "stdin", Typed())
    assert cli.main(["compact", "--level", "aggressive"]) == 0 and "kind=log" in capsys.readouterr().err
    assert cli.main(["perf"]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1].startswith("TOTAL")
    assert cli.main(["doctor"]) == 0 and "fine" in capsys.readouterr().out
    assert cli.main(["version"]) == 0 and cli.main([]) == 0 and "compact" in capsys.readouterr().out


def test_the_tokenizer_of_the_options_counts(spark):
    import public_tokenizers

    df = spark.createDataFrame([("a", LOG)], "id string, text string")
    exact = Options(min_tokens=0, tokenizer="bpe", vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    n = [compact(df, "id", "text", o).first()["original_tokens"] for o in (Options(min_tokens=0), exact)]
    assert n[0] != n[1] > 0


def test_a_registered_compactor_is_used(spark):
    from brevia.plans import pipeline

    before = dict(pipeline._REGISTRY)
    try:
        register("log", lambda df, key, text, o, out: df.withColumn(out, F.lit("short")))
        got = compact(spark.createDataFrame([("a", LOG)], "id string, text string"), "id", "text", Options(min_tokens=0, reversible=False)).first()
        assert (got["kind"], got["text"]) == ("log", "short")
    finally:
        pipeline._REGISTRY.clear()
        pipeline._REGISTRY.update(before)


def test_passages_kept_and_their_savings(spark):
    chunks = spark.createDataFrame([(i, f"chunk {i} about " + " ".join(["topic" + str(i)] * 5)) for i in range(10)], "chunk_idx long, chunk string")
    asked = spark.createDataFrame([(1, "topic3 topic3"), (2, "nothing shared"), (3, "topic4 topic5")], "query_id long, query string")
    kept = lambda **o: sorted((r["query_id"], r["chunk_idx"]) for r in rag.compact_passages(chunks, asked, **o).collect())
    assert kept(max_chunks=0) == kept(max_chunks=1) == [(1, 3), (2, 0), (3, 4)]
    assert kept(max_chunks=5) == [(1, 3), (2, 0), (3, 4), (3, 5)] == kept()
    few, rag.MOST_TERMS = rag.MOST_TERMS, 0
    try:
        assert kept(max_chunks=5) == [(1, 3), (2, 0), (3, 4), (3, 5)]
    finally:
        rag.MOST_TERMS = few
    rows = {r["query_id"]: r for r in rag.passage_savings(chunks, rag.compact_passages(chunks, asked, max_chunks=5)).collect()}
    assert all(r["kind"] == "rag" and 0 < r["compressed_tokens"] < r["original_tokens"] for r in rows.values())
    assert rows[3]["saved_tokens"] < rows[1]["saved_tokens"]
