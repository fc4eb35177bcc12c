"""Histogram sort into shards of equal bytes, with DataFrame operations alone.

Rows are ordered by (hash of the text, hash of the row), so equal texts stand side by side. Splitters are found by
counting: each round sums exact bytes below evenly spaced candidate boundaries inside the few key intervals that still
hold a wanted boundary, and refines those intervals until a boundary lies within the tolerance. Then rows are
exchanged once.

Defined results: a null text has no bytes and counts 1; repeated rows stay together; null ids are ordinary keys; an
empty table gives an empty result; a very long text is one row of its size. Further columns of the input are carried; names made here (shard, slot, size) replace
those of the input. A group of equal texts is kept whole unless its own size exceeds the tolerance at a boundary.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable

MIN = -(1 << 63)


def _prefix(column: str, bits: int) -> Column:
    """The leading bits of a signed long, in its order, as a small number."""
    flipped = F.col(column).bitwiseXOR(F.lit(MIN))
    return F.shiftrightunsigned(flipped, 64 - bits)


def splitters(keys: DataFrame, shards: int, tolerance: float, bits: int = 12) -> list[tuple[int, int]]:
    """Boundaries (k1, k2) of rows (k1 long, k2 long, size long): a row at or above the i-th is in a shard beyond i.

    Reaches the driver: at most (shards - 1) * 2**bits sums a round, whatever the input. Rounds: 64/bits for each half
    of the key at most; a range with one k1 value goes to k2 at once.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack = max(1.0, tolerance * total / shards)
    # for each open boundary: wanted bytes below it, k1 if settled, leading bits so far, their number, bytes below
    open_ = [(total * i / shards, None, 0, 0, 0) for i in range(1, shards)]
    done: list[tuple[int, int]] = []
    while open_:
        following = []
        for k1, depth in {(s[1], s[3]) for s in open_}:
            column = "k1" if k1 is None else "k2"
            here = [s for s in open_ if (s[1], s[3]) == (k1, depth)]
            width = min(64, depth + bits)
            rows = keys if k1 is None else keys.where(F.col("k1") == F.lit(k1))
            if depth:
                rows = rows.where(_prefix(column, depth).isin(sorted({s[2] for s in here})))
            sums = (
                rows.groupBy(_prefix(column, width).alias("p"))
                .agg(F.sum("size").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
                .collect()
            )
            sums.sort(key=lambda r: r["p"] % (1 << 64))
            for want, k, prefix, _, below in here:
                mine = [r for r in sums if (r["p"] % (1 << 64)) >> (width - depth) == prefix]
                ends, at = [], below
                for r in mine:
                    at += r["n"]
                    ends.append(at)
                i = min(bisect_left(ends, want), len(mine) - 1)
                low, high = ends[i] - mine[i]["n"], ends[i]
                single = mine[i]["lo"] == mine[i]["hi"]
                near = min((abs(low - want), 0), (abs(high - want), 1))
                last = single and k is not None
                if near[0] <= slack or last:
                    value = mine[i]["lo"] if near[1] == 0 else mine[i]["hi"] + 1
                    if near[1] and value == 1 << 63:  # above every key of this half
                        done.append((k if k is not None else (1 << 63) - 1, (1 << 63) - 1))
                    else:
                        done.append((value, MIN) if k is None else (k, value))
                elif single:
                    following.append((want, mine[i]["lo"], 0, 0, low))
                else:
                    following.append((want, k, mine[i]["p"] % (1 << 64), width, low))
        open_ = following
    return sorted(done)


def shard_by_bytes(
    docs: DataFrame, keys: DataFrame, shards: int = 8, tolerance: float = 0.005, fine_rows: int = 50_000
) -> DataFrame:
    """docs with k1, k2 and size, dealt to shards of near-equal bytes: adds shard int and slot long.

    keys: the same k1, k2, size, from a table that is cheap to read again. slot counts from 0 without gaps in a shard.
    The one exchange of whole rows is by (shard, fine), where fine is a share of a shard by hash, of about fine_rows rows;
    slots come from the rank in a fine share plus the rows of the shares before it. The offsets broadcast are at most
    shards * 65536 rows of three numbers.
    """
    cuts = splitters(keys, shards, tolerance)
    n = keys.count()
    fine = min(65_536, max(16, -(-n // (shards * fine_rows))))

    def placed(df: DataFrame) -> DataFrame:
        above = [
            ((F.col("k1") > F.lit(a)) | ((F.col("k1") == F.lit(a)) & (F.col("k2") >= F.lit(b)))).cast("int")
            for a, b in cuts
        ]
        shard = sum(above[1:], above[0]) if above else F.lit(0)
        return df.withColumns({"shard": shard.cast("int"), "_fine": F.pmod(F.xxhash64("k2"), F.lit(fine)).cast("int")})

    counts = placed(keys).groupBy("shard", "_fine").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_fine", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_fine").orderBy("k1", "k2"))
    return (
        placed(docs)
        .withColumn("_rank", rank)
        .join(F.broadcast(offsets), ["shard", "_fine"])
        .withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .drop("_fine", "_rank", "_before", "k1", "k2")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 (hash of the text), k2 (hash of the whole row) and size (UTF-8 bytes plus 1)."""
    return docs.withColumns(
        {
            "k1": F.xxhash64("text"),
            "k2": F.xxhash64(*hashable(docs)),
            "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
        }
    )
