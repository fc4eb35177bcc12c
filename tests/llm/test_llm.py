"""The training-data operators against brute force on small tables, and the cases that their docstrings define."""

import collections
import hashlib
import inspect
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle
from brevia.llm import chat, licenses, lm, mixing, packing, queries, sharding, simhash, topk, toxicity, vectors
from brevia.llm.common import ascii_words, components, cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, n=120, seed=0, odd=True):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 80))) + r.choice(["", ".", "\n", " é ü"]), "en", r.choice(["a", "b", "ü", None]), 1) for i in range(n)]
    rows += [(n + i, rows[i][1], "en", "a", 1) for i in range(10)]  # copies
    if odd:
        rows += [(1000, None, None, None, None), (1001, "", "en", "b", 0), (1002, " \n\t ", "en", "b", 0), (1003, "word " * 30_000, "en", "a", 1), (None, "lost id text here", "en", "a", 1)]
        rows += [rows[0], rows[0]]  # rows repeated in full
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_against_union_find(spark):
    r = random.Random(1)
    for edges in ([(i, i + 1) for i in range(60)], [(r.randrange(200), r.randrange(200)) for _ in range(120)], [(0, i) for i in range(1, 50)]):
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# ---- 5 SimHash ----


def brute_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64(x.encode(), seed=42).intdigest() >> b & 1 for x in s) > len(s))


def test_masks_cover_every_pair():
    for radius in (1, 2):
        m = simhash.masks(radius, 12)
        for bits in itertools.combinations(range(12), radius):
            assert any(all(not x >> b & 1 for b in bits) for x in m)
    r = random.Random(0)
    m = [x % (1 << 64) for x in simhash.masks(3)]
    assert len(m) == 15 and all(any(all(not x >> b & 1 for b in bits) for x in m) for bits in (r.sample(range(64), 3) for _ in range(3000)))


def test_simhash_brute(spark):
    df, rows = documents(spark)
    got = [tuple(x) for x in simhash.near_duplicates(df.withColumn("fp", F.lit(1))).collect()]
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(root[j] for j in range(len(fps)) if (fps[i][1] ^ fps[j][1]).bit_count() <= 3) for i in range(len(fps))]
        if new == root:
            break
        root = new
    least = {}
    for (i, _), c in zip(fps, root, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, f"{fp:016x}", least.get(c)) for (i, fp), c in zip(fps, root, strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_fingerprints_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x["node"]: x["root"] for x in components(simhash.fingerprint_links(df)).collect()}
    left, count = set(fps), 0
    groups = collections.Counter(got.get(x, x) for x in signed)
    while left:
        todo = [left.pop()]
        size = 0
        while todo:
            x = todo.pop()
            size += 1
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        count += 1
    assert len(groups) == count


def test_dropping_near_duplicates(spark):
    df, _ = documents(spark)
    df = df.withColumn("times", F.lit(7)).withColumn("kept_id", F.lit(8))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    comps = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, c in comps}
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0
    odd = df.select("doc_id", "text", F.lit(1).alias("kept_row_hash"), F.lit(2).alias("kept_hash"), F.create_map(F.lit("a"), F.col("lang")).alias("row"))
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted(ids, key=str)
    assert {r["kept_hash"] for r in left.collect()} == {2} and simhash.near_duplicates(odd).count() == odd.count()


# ---- 8 sharding ----


def test_shards(spark):
    df, rows = documents(spark, 300)
    hot = spark.createDataFrame([(5000 + i, "the same text again", "en", "a", 1) for i in range(400)], SCHEMA)
    df = df.where("doc_id <> 1003 or doc_id is null").union(hot)
    keyed = cut(sharding.keyed(df.withColumns({"rank": F.lit(1), "before": F.lit(2), "fine": F.lit(3), "shard": F.lit(4)})))
    out = sharding.shard_by_bytes(keyed, keyed.select("k1", "k2", "size"), fine_rows=10).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert len(out) == df.count() and set(by) == set(range(8))
    total = sum(r["size"] for r in out)
    assert all(abs(sum(r["size"] for r in x) - total / 8) < 0.02 * total for x in by.values())
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["text"]].add(r["shard"])
    assert sum(len(s) > 1 for t, s in groups.items() if t != "the same text again") == 0
    none = sharding.keyed(empty(spark))
    assert sharding.shard_by_bytes(none, none.select("k1", "k2", "size")).count() == 0


# ---- 4 mixing ----


def test_visits_and_targets():
    points = [t * mixing.STEP % mixing.WHOLE for t in range(1, 400)]
    for n, low, high in ((0, 0, 9), (399, 5, mixing.WHOLE // 3), (123, mixing.WHOLE // 2, mixing.WHOLE)):
        assert mixing.visits(n, low, high) == sum(low <= p < high for p in points[:n])


def wanted(sizes, weights=(3, 1, 2)):
    """The contract's targets, step by step."""
    w = [weights[i % 3] for i in range(len(sizes))]
    out, full, left = [0.0] * len(sizes), set(), 1.5 * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        over = []
        for i in free:
            out[i] = left * w[i] / sum(w[j] for j in free)
            if out[i] > 2 * sizes[i] + 1e-9:
                over.append(i)
        if not over:
            return out
        for i in over:
            out[i] = 2.0 * sizes[i]
            full.add(i)
        left = 1.5 * sum(sizes) - sum(out[i] for i in full)


def test_times_of_visits():
    r = random.Random(7)
    for _ in range(60):
        low = r.randrange(mixing.WHOLE)
        high = min(mixing.WHOLE, low + r.choice([1 << 63, 1 << 60, 1 << 57, r.randrange(1 << 62) + (1 << 55)]))
        points = [t for t in range(1, 3000) if low <= t * mixing.STEP % mixing.WHOLE < high][:50]
        if len(points) > 5:
            assert mixing.Visits(low, high).times(0, len(points)) == points and mixing.Visits(low, high).times(4, len(points) - 4) == points[4:]


@pytest.mark.parametrize("sizes", [[10**7, 3], [10**6, 1], [5, 5, 5], [40_000] + [1] * 300, [0, 7, 0, 900, 20_000]])
def test_schedule_is_linear(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:05d}", i, z) for i, z in enumerate(sizes)], "skey string, order long, size long")
    sources = mixing.sources_of(rows, (3, 1, 2), 1.5, 2.0, 256)
    slots = mixing.slot_frame(sources, 256).collect()
    need = {x["si"]: x["need"] for x in sources.collect()}
    assert len(slots) == sum(need.values()) and max(x["slot"] for x in slots) <= 3 * len(slots) + 3
    assert len({x["slot"] for x in slots}) == len(slots)
    if len(sizes) == 2:
        assert max(x["slot"] for x in slots) <= 2 * len(slots)
    assert [x["target"] for x in sources.orderBy("si").collect()] == pytest.approx(wanted(sizes), abs=1e-6)


def test_mix(spark):
    df, rows = documents(spark, odd=False)
    df = df.union(spark.createDataFrame([(900, None, "en", "zz", 1), (901, "", "en", "b", 1)], SCHEMA))
    out = mixing.mixed_words(df.withColumn("size", F.lit(1)), block=16).collect()
    again = mixing.mixed_words(df.repartition(7), block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    taken, goal = collections.Counter(), {}
    for r in out:
        assert r["size"] == size.get(r["doc_id"], 0) and r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        goal[source[r["doc_id"]]] = (r["target"], r["source_size"])
    assert all(abs(taken[s] - t) <= 1 for s, (t, _) in goal.items())
    names = sorted((s for s in goal if s is not None)) + [None]
    sizes = [goal[s][1] for s in names]
    assert [goal[s][0] for s in names] == pytest.approx(wanted(sizes))
    assert mixing.mixed_words(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents_follow_the_mix(spark):
    df, _ = documents(spark, 300, odd=False)
    df = df.union(df.limit(3))
    mixed = mixing.mixed_documents(df.withColumns({"size": F.lit(-5), "copies": F.lit(9), "more": F.create_map(F.lit("a"), F.lit(1))}), block=16)
    assert mixed.columns == [*df.columns, "size", "copies", "more"] and {(r["size"], r["copies"]) for r in mixed.select("size", "copies").collect()} == {(-5, 9)}
    want = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mixed_words(df.dropDuplicates(), block=16).collect() if r["size"]}
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(got.values()) <= 4
    assert sum(abs(got[i] - w) > 1.01 for i, w in want.items()) <= 6  # repeated rows and cut documents


# ---- 6 packing ----


def test_pieces_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", "a \n b", " lead", "trail ", "x y 　z", "it's <|endoftext|> ok", "tab\tand\nline", "", "é ü 你好 🙂", "a\n\n  b 12345 ..."]
    e = packing.encoder("byte_bpe_50k")
    for t in odd * 2:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, t
    df, rows = documents(spark)
    out = packing.packed_documents(df, capacity=256, with_ids=True, shard_items=32).collect()
    bins, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 256
    times = collections.Counter(r[0] for r in rows)
    for i, t, *_ in rows:
        want = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(docs[i])
        assert len(parts) % times[i] == 0 and b"".join(p for _, p in parts[:: times[i]]) == want
        assert len(parts) == times[i] or len(want) > 4 * 256
    assert len(bins) <= 1.03 * sum(r["length"] for r in out) / 256 + 1
    assert packing.packed_documents(empty(spark)).count() == 0


def test_crossover_keeps_every_item():
    r = random.Random(4)
    lengths = [r.randint(1, 90) for _ in range(80)]
    a = packing.best_fit(sorted(range(80), key=lambda i: -lengths[i]), lengths, 100, [])
    b = packing.best_fit(list(range(80)), lengths, 100, [])
    child = packing.crossover(a, b, lengths, 100, r)
    assert sorted(i for x in child for i in x) == list(range(80)) and all(sum(lengths[i] for i in x) <= 100 for x in child)
    assert len(packing.evolve(lengths, 100, [a, b], 1)) <= min(len(a), len(b))


# ---- 1 and 7 vectors ----


def vector_rows(seed=5, n=400, d=8):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=d).astype(np.float32)], int(r.integers(0, 3))) for i in range(n)]
    rows += [(n + i, [float(np.float32(x + 0.05 * r.normal())) for x in rows[i][1]], rows[i][2]) for i in range(100)]
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(60)]  # copies
    rows += [(3000, None, 1), (3001, [0.0] * d, 1), (3002, [float("nan")] * d, 1), (3003, [1.0, None], 1), (3004, rows[0][1], None), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [float("inf")] * d, 1), (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("cell_size", [2048, 20])
def test_vector_links_brute(spark, cell_size):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0))
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df, cell_size=cell_size, block=16).collect()}
    fine = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(fine, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    assert len(got) == len(rows)
    seen = {}
    for i, *_ in sorted(fine):
        todo = [i] if i not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                todo += links[x]
    for i, *_ in rows:
        assert (got[i]["n_links"], got[i]["component_id"]) == (len(links[i]), seen.get(i, i)), i
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0
    one, other = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]  # different vectors of one id
    near = spark.createDataFrame([(5, one, 1), (5, other, 1), (6, [1.0, 0.01, 0.0, 0.0], 1), (7, [0.99, 0.0, 0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r["vec_id"], r["n_links"]) for r in vectors.near_duplicate_vectors(near).collect()) == [(5, 0), (5, 2), (6, 2), (7, 2)]


def test_top_k_brute(spark):
    rows = vector_rows()
    rows += [(i, x, y) for i, x, y in rows if i is not None and i < 10]  # repeated in full
    rows += [(20, rows[5][1], 0), (2000, rows[6][1], 1)]  # ids that other vectors have
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"score": F.lit(1), "query": F.lit(2)})
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=64, query_block=16, ahead=12).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    want = collections.defaultdict(list)
    for n, (q, x) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for m, (i, y) in enumerate(fine) if m != n and len(y) == len(x))[:7]
            want[q] += [(k + 1, i, -v) for k, (v, i) in enumerate(scores)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]
    zeros = spark.createDataFrame([(i, [0.0 if i < 3 else float(i % 5), 1.0 if i >= 3 else 0.0]) for i in range(300)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(zeros, F.col("vec_id") == 0, k=5, ahead=6).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_most_vectors_are_not_read(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(50, 32))
    x = centres[np.arange(4000) % 50] + 0.3 * r.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    read = [v["n_read"] for v in topk.top_k(df, F.col("vec_id") % 200 == 0, with_reads=True).select("query_id", "n_read").distinct().collect()]
    assert len(read) == 20 and sum(read) < 0.1 * 20 * 4000


def test_bounds_hold():
    r = np.random.default_rng(3)
    x = np.floor(64 * np.concatenate([r.normal(size=(300, 9)), [[1e6] * 9, [0.0] * 9]]))
    points = topk.steps_of(x)
    codes, apart = topk.approximations(x, points)
    assert all(len(c) == 5 for c in codes)  # four bits a dimension
    assert (topk.upper_bounds(x, topk.unpack(codes, points), apart) >= x @ x.T).all()
    wide = [topk.whole_bytes(v, 64) for v in ([0.5, -0.5], [300.0, 1.0], [1e300, -1.5], [2.0**60, 0.015625])]
    assert [len(w) // 2 for w in wide] == [1, 2, topk.WIDE, topk.WIDE]
    big = topk.exact_scores(wide[2:], [topk.whole_bytes([0.0, 1.0], 64)] * 2, 2)
    assert big.tolist() == [-96 * 64, 64]


# ---- 9 chat ----


def test_chat_round_trip(spark):
    odd = ["", "plain", "\\### Assistant: </turn> ok", "#### </turn>\n### User: x", "\\", "a\\\\</turn>", "é🙂", "###" * 5]
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "we:ird\\#\n", "tool"]), r.choice(odd)) for c in range(20) for t in range(r.randint(1, 6))]
    rows += [(50, None, "user", None), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (None, 0, "user", "u"), (60, 0, "user", "q"), (60, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {x["conv_id"]: x for x in chat.digests(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        by[c].append((role or "", text or ""))
    template = chat.Template()
    for c, turns in by.items():
        whole = "".join(s for role, text in turns for s, _ in chat.segments(role, text, template))
        assert chat.read(whole, template) == turns and got[c]["formatted_chars"] == len(whole) and got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[60]["valid"] and not got[50]["valid"]
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 10 licences ----


def test_license_places_brute(spark):
    df, rows = documents(spark)
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0. cc by nc", "APACHE LICENSE, version 2 and Apache-License--Version 2.0", "under the mit licenses", "xunder the mit license", "This work is licensed under the GNU General Public License, version 3."]
    rows = [*rows, *((2000 + i, t, "en", "a", 1) for i, t in enumerate(lines))]
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        assert (by[i]["n_words"], by[i]["n_base"], by[i]["first_word"], by[i]["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), t
        assert by[i]["base_labels"] == ",".join(sorted({x for _, x in places})) and set(by[i]["base_labels"].split(",")) - {""} <= set(by[i]["labels"].split(","))
    assert by[2005]["labels"] == "gpl-3" and by[2003]["labels"] == "" and by[2000]["score"] == 1.0


def test_templates():
    a = licenses.compile_template("x", "one [[two|two and half]] {{2}} three {{four|five six}} end")
    ok = ["one three four end", "one two three five six end", "one two and half a b three four end", "one a three four end"]
    bad = ["one three end", "one a b c three four end", "one two three seven end", "one three four"]
    match = lambda t: a.match([w.encode() for w in t.split()], 0)
    automata = [licenses.compile_template(*t) for t in licenses.TEMPLATES]
    for label, markup in licenses.TEMPLATES:
        plain = re.sub(r"\[\[.*?\]\]", "", markup)
        plain = re.sub(r"\{\{\d+\}\}", "the authors", re.sub(r"\{\{([^}|0-9]+)\|.*?\}\}", r"\1", plain))
        plain = re.sub(r"\{\{([0-9.]+)\|.*?\}\}", r"\1", plain)
        assert label in licenses.scan_text(f"Some words. {plain}, and more", automata, {})[5].split(","), label
        if label in ("mit", "isc", "bsd-2", "bsd-3") and len(plain) > 300:  # an altered disclaimer isn't the licence's
            assert licenses.scan_text(plain.replace("liable", "reliable"), automata, {})[5] == "" and licenses.scan_text(plain[: len(plain) // 2], automata, {})[5] == ""
    many = "under the mit license, " * 30_000
    assert licenses.scan_text(many, automata, licenses.PHRASES)[:4] == (120_000, 30_000, 0, 119_996)
    assert [match(t) for t in ok] == [len(t.split()) for t in ok] and [match(t) for t in bad] == [-1] * 4


# ---- 2 language model ----


def test_language_model(spark):
    df, rows = documents(spark, 300)
    got = lm.score_documents(df.withColumn("score", F.lit(1)), own=16, shared=12, frequent=30).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t, *_ in rows:
        if not held(i):
            c.update([*ascii_words(t), b""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        tokens = [*ascii_words(t), b""]
        assert by[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert (by[i]["n_tokens"], by[i]["n_known"], by[i]["train_tokens"], by[i]["held_out"]) == (len(tokens), sum(w in c for w in tokens), n, held(i))
    assert lm.score_documents(empty(spark)).count() == 0
    # however the table is dealt out, and whether words are looked up or joined
    again = {r["doc_id"]: r["score"] for r in lm.score_documents(df.repartition(7), own=16, shared=12, frequent=60, shard_tokens=10**9).collect()}
    assert all(again[i] == pytest.approx(r["score"], rel=1e-6) for i, r in by.items())
    # a table that nothing is learned from
    none = lm.score_documents(df.where("crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert none and all(r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in none)


def test_model_is_normalised_and_learns():
    r = np.random.default_rng(0)
    follow = r.permutation(20)
    x = [0, 0]
    for _ in range(40_000):
        x.append(int(follow[x[-1]]) if r.random() < 0.8 else int(r.integers(0, 20)))
    x = np.array(x)
    counts = np.bincount(x, minlength=20).astype(float) + 1
    m = lm.Model.start(counts, 8)
    t = lm.Trainer(m, counts, samples=32)

    def score(model):
        one, two, z = model.tables()
        p = np.exp(one[:, None, :].astype(float) + two[None] - z[:, :, None])
        assert p.sum(axis=2) == pytest.approx(np.ones((20, 20)), abs=1e-4)
        return float(np.log(p[x[1:-1], x[:-2], x[2:]]).mean())

    before = score(m)
    for _ in range(3):
        for at in range(2, len(x) - 256, 256):
            i = np.arange(at, at + 256)
            t.step(x[i - 1], x[i - 2], x[i])
    assert score(m) > before + 0.5


def test_probabilities_sum_to_one(spark, monkeypatch):
    """All words of up to five of three letters, in every class: counts and spelling add up."""
    monkeypatch.setattr(lm, "LETTERS", np.array([97, 98, 99]))
    r = random.Random(9)
    tokens = ["".join(r.choices("abc", weights=(5, 3, 1), k=r.choice([1, 2, 2, 3]))) for _ in range(3000)]
    counts = spark.createDataFrame([*collections.Counter(tokens).items(), ("", 200)], "word string, c long")
    v = lm.vocabulary(counts, 6, 20)
    e = lm.endings(counts, v, 6)
    assert v.words[0] == b"" and v.tokens == 3200 and lm.class_counts(v, e).sum() == 3200 + v.own + e.count
    c = collections.Counter(tokens)
    every = ["".join(x).encode() for n in range(1, 13) for x in itertools.product("abc", repeat=n)]
    kind, spelled = e.numbers(every), np.exp(e.spelled(every))
    known = set(v.words[: v.own])
    seen = np.array([0 if w in known else c[w.decode()] for w in every])
    p = (1 - e.unseen[kind]) * seen / np.maximum(e.n[kind], 1) + e.unseen[kind] * spelled
    total = np.bincount(kind, weights=p, minlength=e.count)[np.unique(kind)]
    assert (total <= 1 + 1e-9).all() and (total > 0.97).all()  # what is left is longer than twelve letters
    inner = lm.inner_scores(v, e)
    at = {w: i for i, w in enumerate(every)}
    assert inner[v.own :] == pytest.approx(np.log10([p[at[w]] for w in v.words[v.own :]])) and (inner[: v.own] == 0).all()


def test_model_beats_its_unigram(spark):
    """On held-out texts, per token, against the same classes and spelling without contexts."""
    r = random.Random(10)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 7))) for _ in range(400)]
    after = {w: r.choices(words, k=4) for w in words}
    rows = []
    for i in range(1500):
        text = [r.choice(words)]
        for _ in range(60):
            text.append(r.choice(after[text[-1]]) if r.random() < 0.8 else r.choice(words))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = lm.train

    def flat(docs, v, e, **_):
        m = lm.Model.start(lm.class_counts(v, e), 4)
        m.q[:] = 0
        return m

    mean = lambda out: sum(x["score"] for x in out if x["held_out"]) / sum(x["n_tokens"] for x in out if x["held_out"])
    model = mean(lm.score_documents(df, own=300, shared=100).collect())
    try:
        lm.train = flat
        unigram = mean(lm.score_documents(df, own=300, shared=100).collect())
    finally:
        lm.train = real
    assert model > unigram + 0.2


# ---- 3 toxicity ----


def test_toxicity(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(40)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = r.choices(words, k=20) + (["zorg" + r.choice(["a", "en", "ly", "is"])] if bad else []) + r.choices(["women", "muslims", "old"], k=int(bad) * 2 or r.randint(0, 1))
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, int(bad)))
    rows += [(9000, "we met women and muslims and old friends", "en", "a", 1), (9001, None, "en", "a", 1), (9002, "", "en", "a", 1), (None, "zorgen", "en", "a", 1), (9003, "all zorgful", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    got = {x["doc_id"]: x for x in toxicity.score_documents(df, model, ["doc_id"]).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and sum(got[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert got[9000]["predicted"] == 0 and got[9001]["score"] == got[9002]["score"] < 0.5 and got[9003]["predicted"] == 1
    clean = toxicity.drop_toxic(df.withColumn("c0", F.lit(1)), marks)
    assert clean.columns == [*df.columns, "c0"] and {x["doc_id"] for x in clean.collect()} == {i for i, x in got.items() if not x["predicted"]}
    assert toxicity.score_documents(empty(spark), model, ["doc_id"]).count() == 0
    assert toxicity.score_documents(df, toxicity.train(df, marks.limit(0)), ["doc_id"]).where("predicted = 1").count() == 0


def test_sampled_labels_keep_their_shares(spark):
    rows = [(i, "the same few words for all") for i in range(1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 11 == 0)) for i, _ in rows], "doc_id long, toxic int")
    scores = [toxicity.scorer(toxicity.train(df, marks, most_rows=m))(["the same few words for all"])[0] for m in (5000, 60)]
    assert abs(scores[0] - 1 / 11) < 0.03 and abs(scores[1] - scores[0]) < 0.03


def test_bounds_of_the_fit(spark):
    rows = [(i, f"plain words w{i % 40}" + (" vile" if i % 2 else "")) for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids, stands_for = toxicity._training_rows(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), 10**9, inspect.signature(toxicity.train).parameters["most_rows"].default)
    assert ids.count() >= 23_999 and stands_for == [1.0, 1.0]
    assert inspect.signature(toxicity.train).parameters["most_features"].default == 20_000


def _fit(rows, pairs, y, k, penalty):
    y = np.array(y, dtype=float)
    block = toxicity._block([np.array(x, dtype=np.int32) for x in rows], y, np.ones(len(y)), k)
    none = toxicity._block([], np.zeros(0), np.zeros(0), k)
    return toxicity.fit(lambda w: toxicity._loss(block, w), none, [(np.array(f, dtype=np.int64), n) for f, n in pairs], y.sum(), len(y) - y.sum(), k, penalty)


def test_fit_takes_rows_without_features():
    w, b = _fit([[], [0], [], [0]] * 10, [], [0, 1, 0, 1] * 10, 1, 1.0)
    assert b < 0 < b + w[0]


def test_swaps_cost_nothing_in_score():
    rows, y = [[0, 1], [1], [2], [2, 3]] * 20, [1, 1, 0, 0] * 20
    free, _ = _fit(rows, [([1, -1 - 4], 40)], y, 5, 0.0)
    held, _ = _fit(rows, [([1, -1 - 4], 40)], y, 5, 50.0)
    assert abs(held[1] - held[4]) < 0.2 * abs(free[1] - free[4])


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    block = toxicity._block([r.integers(0, 6, 4).astype(np.int32) for _ in range(9)], r.integers(0, 2, 9), r.random(9), 6)
    w = r.normal(size=7)
    _, g = toxicity._loss(block, w)
    step = 1e-6 * np.eye(7)
    assert g == pytest.approx([(toxicity._loss(block, w + d)[0] - toxicity._loss(block, w - d)[0]) / 2e-6 for d in step], abs=1e-5)


def test_features_of_any_words():
    for words in ([], [b"a"], [b"ab", b"a"], [b"x" * 5000, b"ab", "ü".encode()]):
        owner, feature = toxicity.features_of(words)
        assert len(owner) == len(feature) and sorted(set(owner.tolist())) == list(range(len(words)))
        for i, w in enumerate(words):  # whatever stands beside a word
            alone = toxicity.features_of([w])[1]
            assert feature[owner == i].tolist() == alone.tolist() and len(alone) == 1 + max(0, len(w) - 1) + max(0, len(w) - 2)


def test_swaps_by_sentence():
    text = "The women left. Men and women came! An old man\nnothing here"
    assert sorted(toxicity.swaps(text)) == sorted([(b"women", b"men"), (b"men", b""), (b"women", b""), (b"old", b"young"), (b"man", b"woman")])
    assert list(toxicity.swaps(None)) == list(toxicity.swaps("nobody")) == []


def test_counterfactuals_cut_false_alarms(spark):
    """Toxic texts mostly name one group: without the penalty neutral sentences about it are taken for toxic."""
    r = random.Random(12)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = r.choices(words, k=8) + (["muslims"] if r.random() < (0.95 if bad else 0.01) else []) + (["vile"] if bad and r.random() < 0.5 else [])
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = toxicity.false_alarms(toxicity.train(df, marks, penalty=0.0, neutral=0.0))
    fair = toxicity.false_alarms(toxicity.train(df, marks))
    assert plain["muslims"] >= 0.5 and max(fair.values()) == 0
    # ids that stand on many documents are learned from once
    many = df.union(df.where("doc_id < 300")).union(df.where("doc_id < 300"))
    ids, _ = toxicity._training_rows(many, marks, 5, 50)
    assert ids.count() == 100
    kept = toxicity.score_documents(df.withColumns({"held_out": F.lit(7), "score": F.lit("s")}), toxicity.train(df, marks), ["doc_id", "held_out"])
    assert kept.columns == ["doc_id", "held_out", "held_out", "score", "predicted"] and kept.count() == 900


# ---- the registered queries ----


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.difference(got, oracle.connect(sf_dir).execute(queries.ORACLES[name]).df()) == ""


def test_query_of_shards(spark, sf_dir):
    out = queries.op8_histogram_sort_shards(spark, sf_dir).collect()
    texts = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        texts[r["doc_id"]].append((r["text"] or "").encode())
    total, by = sum(r["size"] for r in out), collections.defaultdict(list)
    for r in out:
        assert (r["size"], r["text_crc32"]) in [(len(t) + 1, zlib.crc32(t)) for t in texts[r["doc_id"]]]
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        by[r["shard"]].append(r)
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, t in texts.items() for _ in t) and set(by) == set(range(8))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    largest = max(len(t) for ts in texts.values() for t in ts)
    assert all(abs(sum(r["size"] for r in x) - total / 8) <= 0.01 * total + largest for x in by.values())


@pytest.mark.parametrize("name", ["op2_lm_scoring", "op3_toxicity", "op4_source_mixing", "op5_simhash_near_dedup", "op10_license_scan"])
def test_queries_return_every_document(name, spark, sf_dir):
    out = queries.QUERIES[name](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    if name == "op3_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_query_of_packing(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op6_best_fit_packing(spark, sf_dir).collect():
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(docs.pop(r["doc_id"]))
        assert [p for p, *_ in parts] == list(range(len(parts))) and sum(n for _, _, n, _ in parts) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for _, a, n, c in parts) and all(n == 2048 for _, _, n, _ in parts[1:])
    assert not docs
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 2048


def test_evolution_saves_bins():
    """Triplets: three items fill a bin to the brim in each best packing, which best fit alone hardly finds."""
    saved = 0
    for seed in range(4):
        r = random.Random(seed)
        lengths = []
        for _ in range(30):
            a = r.randint(380, 490)
            b = r.randint(250, (1000 - a) // 2 - 1)
            lengths += [a, b, 1000 - a - b]
        first = packing.best_fit(sorted(range(90), key=lambda i: -lengths[i]), lengths, 1000, [])
        best = packing.evolve(lengths, 1000, [], seed)
        assert len(best) <= len(first) and sorted(i for x in best for i in x) == list(range(90))
        saved += len(first) - len(best)
    assert saved > 0


# ---- the pipeline ----


def test_pipeline_keeps_the_right_documents(spark, tmp_path):
    """Each stage against plain Python on odd rows: nulls, empties, ties, repeats, a long text and more columns."""
    import corpus_pipeline

    df, rows = documents(spark, 200)
    bad = [(3000 + i, rows[i][1] + " zorgful idiot", "en", "a", 1) for i in range(60)]
    df = df.union(spark.createDataFrame(bad, SCHEMA)).withColumns({"score": F.lit(3), "kept_hash": F.lit(4), "more": F.create_map(F.lit("x"), F.lit(1))})
    marks = [(i, 0, 0) for i in range(200)] + [(i, 0, 1) for i, *_ in bad]
    df.drop("more").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = cut(corpus_pipeline.toxicity(spark, df, str(tmp_path)))
    assert clean.columns == df.columns
    ids = lambda d: collections.Counter(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(clean) == collections.Counter(i for i, *_ in rows)
    one = cut(corpus_pipeline.simhash_near_dedup(spark, clean, str(tmp_path)))
    assert one.columns == df.columns and set(ids(one).values()) == {1}
    texts = {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        texts.setdefault(tuple(ascii_words(t)), i)
    assert set(ids(one)) == set(texts.values())  # random texts are near only to equal ones
    mixed = cut(corpus_pipeline.mixing(spark, one, str(tmp_path)))
    size = {r["doc_id"]: len(ascii_words(r["text"])) for r in one.collect()}
    got = ids(mixed)
    assert mixed.columns == df.columns and set(got) <= {i for i, n in size.items() if n} and max(got.values()) <= 2
    # whole documents: where a source's last round ends, one of it is rounded
    assert abs(sum(n * size[i] for i, n in got.items()) - 1.5 * sum(size.values())) <= max(size.values())
    packed = corpus_pipeline.best_fit_packing(spark, mixed, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == got
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    none = spark.createDataFrame([], df.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0



def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, sf_dir)
    rows = packed.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
    bins = collections.Counter()
    for x in rows:
        bins[x["sequence_id"]] += x["length"]
    assert max(bins.values()) <= 2048


def test_near_texts_of_the_pipeline_brute(spark):
    import corpus_pipeline

    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(500)]
    rows = []
    for g in range(30):
        text = r.choices(words, k=r.randint(40, 150))
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):  # drifting copies, about 0.7 to 1 alike
            text = list(text)
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "one three"), (None, rows[5][1]), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = ascii_words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or (x & y and len(x & y) >= 0.8 * len(x | y)):
            root = [root[a] if q == root[b] else q for q in root]
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root[i]] = min(best.get(root[i], (True, 0)), (d is None, d if d is not None else 0))
    got = [x["doc_id"] for x in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()]
    assert sorted(got) == sorted(d for _, d in best.values())
    kept_before = {x["doc_id"] for x in simhash.drop_near_duplicates(df).collect()}
    assert len(kept_before) > len(got)


def test_pipeline_finds_near_texts_by_simhash(spark, monkeypatch):
    """The stage compares what near_groups() joins by fingerprints of many bands and cut buckets, and loses no near pair."""
    import corpus_pipeline
    from brevia.llm import jaccard

    monkeypatch.setattr(simhash, "CROWD", 16)
    monkeypatch.setattr(simhash, "BLOCK", 24)
    monkeypatch.setattr(jaccard, "BLOCK", 24)
    r = random.Random(17)
    words = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(900)]
    texts = []
    for g in range(60):
        text = r.choices(words, k=r.choice([8, 9, 12, 60, 200]) if g else 200)
        texts.append(" ".join(text))
        for _ in range(2 if g else 40):  # one large group of near copies
            one = list(text)
            for _ in range(r.randint(0, 2)):
                one[r.choice([0, len(one) // 2, -1])] = r.choice(words)
            texts.append(" ".join(one))
    sets = {}
    for t in texts:
        node, size, fp = jaccard.signature(jaccard.shingles_of(t))
        sets[node] = (jaccard.shingles_of(t), size, fp)
    some = next(iter(sets.values()))
    mix = lambda x: (x ^ x >> 31)
    votes = [0] * simhash.WIDE
    for s in some[0]:
        for w in range(simhash.WIDE // 64):
            x = (xxhash.xxh64_intdigest(s, simhash.SEED) + (w + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = mix((x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64))
            for b in range(64):
                votes[64 * w + b] += x >> b & 1
    want = [sum(1 << b for b in range(64) if 2 * votes[64 * w + b] > len(some[0])) for w in range(simhash.WIDE // 64)]
    assert some[2].view(np.uint64).tolist() == want

    df = spark.createDataFrame([(n, s[1], s[2].tolist()) for n, s in sets.items()], "node long, size int, fp array<long>")
    at = simhash.bands(len(sets), 0.8)
    assert at.shape[1] >= 3 and len(at) > 10
    grouped = collections.defaultdict(set)
    for x in simhash.near_groups(df, at).collect():
        grouped[x["node"]].add(x["key"])
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard.is_near(sets[a][0], sets[b][0], 0.8)]
    assert len(near) > 100 and all(grouped[a] & grouped[b] for a, b in near)
    assert len(grouped) < len(sets)  # most unlike texts are told apart by their bits

    calls = []
    monkeypatch.setattr(jaccard, "near_groups", lambda *a, **k: calls.append(1) or simhash.near_groups(*a, **k))
    root = {n: n for n in sets}
    for a, b in near:
        a, b = root[a], root[b]
        root = {n: a if x == b else x for n, x in root.items()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(root[jaccard.signature(jaccard.shingles_of(t))[0]], i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == sorted(first.values()) and calls == [1]
