"""Near-duplicate texts: 64-bit SimHash, linked through covering locality-sensitive hashing; wide SimHash for looser similarities.

A fingerprint bit is set if it is set in over half of the XXH64 values of the text's word shingles. Candidates come from
2**(radius+1) - 1 bit masks (Pagh, 2016): bit i carries a non-zero code c(i) of radius+1 bits, and mask v keeps the bits
whose code has an odd overlap with v. Any `radius` codes leave a non-zero v that is even with all of them, so a pair that
differs in up to `radius` bits agrees under some mask for certain: no link is lost.

Defined results: null or word-less texts have fingerprint zero and link like others; shorter texts give one shingle;
repeated rows and null ids are kept as rows, and an id that is null is never a component's id (a component of null ids
only has a null id); an empty table gives an empty result; very long texts are read whole, their shingles in chunks; other columns may
have any names and types: they are carried, and those that Spark can't hash (maps, variants) don't tell rows apart.

Sets of shingles that share 0.8 of them differ in about 0.15 of their SimHash bits, too many for masks that prune. Their fingerprints are WIDE
bits long and are cut to bands of a few bits: sets that agree in a band are a bucket, of some CROWD sets. In a bucket the Hamming
distance decides. near_groups() gives what must be compared on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, components, cut, hashable, map_texts

SEED = 42
#: Fingerprints of one task at most, twice: larger buckets are compared block by block.
BLOCK = 2048
CHUNK = 1 << 16
#: Bits of wide fingerprints, words of them in a bucket's rows, sets to a bucket, chance that sets at the similarity share no bucket.
WIDE, CARRIED, CROWD, MISSED = 512, 4, 512, 5e-8
#: Share of bits that differ at a similarity of 0.8, at most, for sets of less than SMALL and others: ties make it more than the angle does, 0.152.
SMALL, DIFFER = 18, (0.19, 0.16)
_STEPS = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(words: list[bytes], k: int = 3) -> int:
    """The unsigned SimHash of a sequence of words."""
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(k)), strict=False)] if len(words) > k else [b" ".join(words)]
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + CHUNK]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row (doc_id, row_hash, fp) per document; fp is the fingerprint's bits as a signed long."""

    def run(texts: list) -> list:
        return [np.array([fingerprint(ascii_words(t), k) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs.select("doc_id", F.xxhash64(*hashable(docs)).alias("row_hash"), "text"), ["doc_id", "row_hash"], "fp long", run)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks, as signed longs."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    out = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _joined(root: np.ndarray, near: np.ndarray, lag: int) -> np.ndarray:
    """root after links of the positions near to those lag behind."""
    near = near[root[near] != root[near + lag]]
    while len(near):
        a, b = root[near], root[near + lag]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        near = near[root[near] != root[near + lag]]
    return root


def _forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of neighbouring rows, thinned to a spanning forest: pairs of positions."""
    root = np.arange(len(fp))
    at, lag = root, 1
    while True:
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        root = _joined(root, at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius], lag)
        lag += 1
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return linked, root[linked]


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fp within `radius` bits.

    Buckets are (mask, masked bits). A bucket of more than BLOCK fingerprints is cut into hash blocks and every pair of
    blocks is a task of its own, so no task holds more than two blocks; each yields a spanning forest, not its pairs.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    rows = fps.select("fp", keys.alias("at")).select("fp", "at.t", "at.key")
    sizes = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(sizes, ["t", "key"])
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp", "t"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own"))))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    order = ["t", "key", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None

        def links(b: pd.DataFrame) -> pd.DataFrame:
            k = b[order].to_numpy(dtype=np.int64)
            group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            fp = b["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            a, r = _forest(group, fp, radius)
            return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[r].view(np.int64)})

        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            last = (b[order] == b[order].iloc[-1]).all(axis=1).to_numpy()
            kept = b[last]
            if not last.all():
                yield links(b[~last])
        if kept is not None and len(kept):
            yield links(kept)

    return rows.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long")


def roots_of(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps (fp distinct, ...) with root, a fingerprint of the component."""
    comps = components(fingerprint_links(fps.select("fp"), radius))
    return fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of WIDE bits of a set, given as 64-bit hashes; signed. Each hash is mixed to a word for each 64 bits."""
    votes = np.zeros(WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many votes fit a byte
        x = hashes[at : at + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)


def within(bits: int, size: np.ndarray) -> np.ndarray:
    """How many of so many bits differ at a similarity of 0.8 at most, but for some 1 in 10**8 pairs; by the smaller set's size."""
    most = [math.ceil(bits * q + 6 * math.sqrt(bits * q * (1 - q))) for q in DIFFER]
    return np.where(size < SMALL, *most)


def bands(sets: int, similarity: float) -> np.ndarray:
    """The bits of each band, for so many sets: one row a band. Few sets are one bucket, of no bits.

    Long texts of equal size at the similarity agree in a bit with the probability 1 - angle / pi; the angle's cosine is 2 * similarity / (1 + similarity).
    """
    bits = max(0, math.ceil(math.log2(max(1, sets) / CROWD)))
    if not bits:
        return np.zeros((1, 0), dtype=np.int64)
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    count, each = math.ceil(math.log(MISSED) / math.log1p(-(agree**bits))), WIDE // bits
    rng = np.random.default_rng(SEED)
    return np.concatenate([rng.permutation(WIDE)[: each * bits].reshape(each, bits) for _ in range(-(-count // each))])[:count]


def _near_heads(group: np.ndarray, size: np.ndarray, fp: np.ndarray, similarity: float) -> np.ndarray:
    """For rows by group and size: the first row that each is joined to by pairs of a group whose sizes and fingerprints (words, rows) are near."""
    half, limits = CARRIED // 2, (within(32 * CARRIED, size), within(64 * CARRIED, size))
    root = np.arange(len(size))
    at, lag = root, 1
    while True:
        at = at[at + lag < len(size)]
        at = at[(group[at] == group[at + lag]) & (size[at] >= similarity * size[at + lag])]
        if not len(at):
            return root
        near, far = at, 0
        for words, limit in zip((fp[:half], fp[half:]), limits, strict=True):
            far = far + sum(np.bitwise_count(w[near] ^ w[near + lag]).astype(np.int16) for w in words)
            few = far <= limit[near]
            near, far = near[few], far[few]
        root = _joined(root, near, lag)
        lag += 1


def cells(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The buckets of fingerprints (rows, words), one a band of bands(), in the bands' order."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    cell = np.tile(np.arange(len(at), dtype=np.int64) << 40, (len(fp), 1))
    for i in range(at.shape[1]):
        cell |= bits[:, at[:, i]].astype(np.int64) << i
    return cell


def near_groups(sets: DataFrame, at: np.ndarray, similarity: float = 0.8) -> DataFrame:
    """(cell, key, node): groups of sets (node, size, fp of WIDE bits) such that all pairs at the similarity or above share one, but for MISSED.

    at is bands() of their number; cell is the bucket and key the group.
    A bucket of more than BLOCK sets is cut as in fingerprint_links(). A group joins what is near in a bucket by size and Hamming distance.
    """
    words = [f"w{i}" for i in range(CARRIED)]
    schema = f"node long, size int, {', '.join(f'{w} long' for w in words)}, cells array<long>"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE // 64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * len(at)), pa.array(cells(fp, at).ravel()))
            columns = [b.column("node"), b.column("size"), *(pa.array(fp[:, i]) for i in range(CARRIED)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", *words, "cells"])

    rows = sets.select("node", "size", "fp").mapInArrow(dealt, schema).select("node", "size", *words, F.explode("cells").alias("cell"))
    crowded = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    part = F.lit(0).cast("long")
    if not crowded.isEmpty():
        rows = rows.join(crowded, "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")))
        other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
            F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("own"))))
        rows = rows.withColumn("other", other)
        part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    rows = rows.select("cell", part.alias("part"), "size", "node", *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def groups(c: list[np.ndarray]) -> pa.RecordBatch:
            cell, part, size, node = c[:4]
            group = np.concatenate([[0], np.cumsum((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))])
            head = _near_heads(group, size, np.stack(c[4:]).view(np.uint64), similarity)
            many = np.bincount(head)[head] > 1
            return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (cell, part, node[head], node)], names=["cell", "part", "head", "node"])

        for b in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            c = c if kept is None else [np.concatenate(x) for x in zip(kept, c, strict=True)]
            if not len(c[0]):
                continue
            last = (c[0] == c[0][-1]) & (c[1] == c[1][-1])
            kept = [x[last] for x in c]
            if not last.all():
                yield groups([x[~last] for x in c])
        if kept is not None and len(kept[0]):
            yield groups(kept)

    found = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "size").mapInArrow(run, "cell long, part long, head long, node long")
    return found.select("cell", F.xxhash64("cell", "part", "head").alias("key"), "node")


def near_duplicates(docs: DataFrame, radius: int = 3, k: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Components are found over distinct fingerprints, each with its smallest id; documents are joined once, to a written table, so
    that Spark can split the partition of a fingerprint that very many documents share.
    """
    slim = cut(fingerprints(docs, k))
    rooted = cut(roots_of(cut(slim.groupBy("fp").agg(F.min("doc_id").alias("first"))), radius))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    found = cut(rooted.join(least, "root").select("fp", "component_id"))
    return slim.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 3, k: int = 3) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (null last), and of equal ids the least row hash.

    Whole rows are joined once to the ids kept; only fully repeated rows among those are compared again.
    """
    slim = cut(fingerprints(docs, k))
    roots = cut(roots_of(cut(slim.select("fp").distinct()), radius))
    return keep_one(docs, slim.join(roots, "fp"))


def keep_one(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """docs with one document of each root in rooted (doc_id, row_hash, root, ...), as in drop_near_duplicates()."""
    times = rooted.groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("times"))
    key = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_hash", "times")
    best = times.groupBy("root").agg(F.min(key).alias("best"))
    kept = cut(best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.row_hash").alias("kept_hash"), "best.times"))
    # the input's columns get names of their own meanwhile, so that none is taken for one made here
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    hashed = docs.select(*(F.col(c).alias(n) for c, n in own.items()), F.xxhash64(*hashable(docs)).alias("kept_hash"))
    found = hashed.join(kept, F.col(own["doc_id"]).eqNullSafe(kept["kept_id"]) & (hashed["kept_hash"] == kept["kept_hash"]))
    back = [F.col(n).alias(c) for c, n in own.items()]
    once = found.where("times = 1").select(back)
    if kept.where("times > 1").isEmpty():
        return once
    # rows repeated in full, or but for columns that can't be hashed: any one of them
    many = found.where("times > 1").drop(kept["kept_hash"]).groupBy("kept_id", "kept_hash").agg(F.first(F.struct(*own.values())).alias("row"))
    return once.union(many.select(*(F.col(f"row.{n}").alias(c) for c, n in own.items())))
