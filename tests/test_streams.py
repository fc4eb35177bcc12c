"""Streams that remember by key give what plain Python and the batch forms give, also over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from brevia.plans import conversations as conv
from brevia.streaming import keyed

ROWS = "id long, key string, s long, body string"
#: (id, key, second, body): a body puts, none asks.
ENTRIES = [
    (1, "a", 10, None), (2, "a", 20, "x"), (3, "a", 30, None), (4, "b", 30, None), (5, "b", 40, "y"), (6, "a", 120, None), (7, "a", 121, None), (8, "a", 130, "z"),
    (9, "a", 130, None), (10, "b", 140, None), (11, "b", 141, None), (12, None, 150, "n"), (13, None, 151, None), (14, "c", 160, ""), (15, "c", 161, None),
]


def stream(spark, rows, schema, path, batches=1):
    """A stream over rows with seconds `s` after an hour as time, in so many micro-batches, cut in the order given."""
    step = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 3600)).coalesce(1)
        part.write.mode("append").parquet(str(path))
        last = part.schema
    return spark.readStream.schema(last).option("maxFilesPerTrigger", 1).parquet(str(path))


def cache(rows, ttl, most=None):
    held, out = {}, {}
    for i, key, s, body in rows:
        key = key or ""
        if body is not None:
            if most is not None and len(held) >= most:
                held.pop(next(iter(held)))
            held[key] = (s, body)
        else:
            if key in held and 0 < ttl < s - held[key][0]:
                held.pop(key)
            out[i] = held[key][1] if key in held else None
    return out


def found(df):
    rows = keyed.drained(df).collect()
    assert all(r["hit"] == (r["found"] is not None) for r in rows) and len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["found"] for r in rows}


@pytest.mark.parametrize("batches", [1, 5])
def test_entries_expire(spark, tmp_path, batches):
    got = found(keyed.stored_entries(stream(spark, ENTRIES, ROWS, tmp_path / "in", batches), ttl=100))
    assert got == cache(ENTRIES, 100) and got[3] == "x" and got[6] == "x" and got[7] is None and got[10] == "y" and got[15] == ""


def test_entries_may_live_for_ever(spark, tmp_path):
    assert found(keyed.stored_entries(stream(spark, ENTRIES, ROWS, tmp_path / "in", 3), ttl=0)) == cache(ENTRIES, 0)


@pytest.mark.parametrize("batches", [1, 4])
def test_the_cache_drops_what_came_first(spark, tmp_path, batches):
    rows = [(i, f"k{(i * i + i // 3) % 5}", i, None if i % 2 else f"v{i}") for i in range(60)]
    got = found(keyed.cached_responses(stream(spark, rows, ROWS, tmp_path / "in", batches), ttl=0, most=3))
    assert got == cache(rows, 0, 3) and None in got.values() and len(set(got.values())) > 3


def test_slots_keep_every_key_apart(spark, tmp_path):
    got = found(keyed.cached_responses(stream(spark, ENTRIES, ROWS, tmp_path / "in", 2), ttl=100, most=400, slots=4))
    assert got == cache(ENTRIES, 100)


TURNS = "conv_id long, turn long, role string, text string, s long"


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_equal_the_batch_form(spark, tmp_path, batches):
    long_ = "The ledger refused the batch because shard seven was behind its leader by many entries. " * 4
    rows = []
    for c in (1, 2):
        texts = [long_ + "one", "short", None, long_ + "two", "short", long_ + "one", "unlike " * 60, long_[::-1], "unlike " * 60, ""]
        rows += [(c, t, "system" if c == 2 and t == 0 else "user", text, t) for t, text in enumerate(texts)]
    rows.sort(key=lambda r: r[4])
    got = keyed.drained(keyed.repeats_so_far(stream(spark, rows, TURNS, tmp_path / "in", batches)))
    turns = spark.createDataFrame(rows, TURNS)
    placed = conv.positions(turns, 0)
    expected = placed.join(conv.repeats(placed), ["conv_id", "pos"], "left").select("conv_id", "turn", "pos", "dup")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert {(r["conv_id"], r["pos"]): r["dup"] for r in got.collect()}[1, 3] == 0


def test_silent_conversations_are_forgotten(spark, tmp_path):
    text = "A message that is long enough to be looked for among those that stand before it. " * 4
    rows = [(1, 0, "user", text, 0), (2, 0, "user", "x", 10_000), (2, 1, "user", "y", 10_001), (1, 1, "user", text, 20_000)]
    got = keyed.drained(keyed.repeats_so_far(stream(spark, rows, TURNS, tmp_path / "in", 4), silence=100, late="1 second"))
    assert {(r["conv_id"], r["turn"]): (r["pos"], r["dup"]) for r in got.collect()}[1, 1] == (0, None)


def test_empty_streams(spark, tmp_path):
    assert found(keyed.stored_entries(stream(spark, [], ROWS, tmp_path / "in"))) == {}
