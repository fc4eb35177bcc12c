"""Exact top-k search by inner product with a vector-approximation file.

Vectors become integers; equal ones are one class. The file holds for each class four bits a dimension, packed, and the distance of
the vector from the point those bits stand for. A scan of the file bounds every score from above: with the approximate vector c and
distance e, q.x <= q.c + |q| e. Exact vectors are then read in the order of these bounds, in two steps: first the `ahead` best bounds
of each query; where the next bound could still pass the k-th exact score, a second scan names every class that could, and all of
those are read. Nothing else is, and no candidate that counts is left out.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different lengths
aren't compared; a null vec_id takes no part; repeated rows, and rows that share an id, are rows of their own, and only the query's own row
isn't its candidate; ties go to the smaller id; fewer candidates than k are all returned; an empty table gives an empty result; very
long vectors make wide rows and blocks of fewer of them; other columns, whatever their names, aren't read. Integers are exact at any size;
scores beyond 64 bits are returned as the largest or smallest long and tie there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that the steps of the file are fitted to at most; results don't depend on them.
SAMPLE = 8192
STEPS = 16
#: Relative slack for rounding in bounds.
SLACK = 1e-9
#: Bytes of an integer that fits no machine word; the largest double times a scale below 2**60 does.
WIDE = 136
SCORE_MIN, SCORE_MAX = -(1 << 63), (1 << 63) - 1


def valid_vectors(vectors: DataFrame, name: str = "embedding"):
    """Rows whose vector has components, all finite."""
    big = F.lit(float("inf"))
    fine = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return vectors.where(F.col(name).isNotNull()).where((F.size(name) > 0) & F.coalesce(fine, F.lit(False)))


# ---- integers and codes ----


def whole_bytes(vector, scale: int) -> bytes:
    """floor(scale * x) of each component in the least of 1, 2, 4, 8 or WIDE bytes that holds all, little-endian."""
    x = np.asarray(vector, dtype=np.float64)
    top = np.abs(x).max() * scale + 1
    for n in (1, 2, 4, 8):
        # floats up to 2**52 have exact products with a scale of 64; larger ones are whole numbers already
        if top < 2.0 ** min(8 * n - 1, 52):
            return np.floor(scale * x).astype(f"<i{n}").tobytes()
    return b"".join((int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale)).to_bytes(WIDE, "little", signed=True) for v in x.tolist())


def _integers(rows: list[bytes], dim: int) -> np.ndarray:
    """The integers of rows of equal width: int64, or objects where they need more."""
    n = len(rows[0]) // dim
    data = b"".join(rows)
    if n <= 8:
        return np.frombuffer(data, dtype=f"<i{n}").reshape(-1, dim).astype(np.int64)
    parts = [int.from_bytes(data[i : i + n], "little", signed=True) for i in range(0, len(data), n)]
    return np.array(parts, dtype=object).reshape(-1, dim)


def _floats(rows: list[bytes], dim: int) -> np.ndarray:
    """The integers of rows of any widths, rounded to floats."""
    out = np.empty((len(rows), dim))
    widths = np.array([len(r) for r in rows])
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = _integers([rows[i] for i in at], dim).astype(np.float64)
    return out


def exact_scores(a: list[bytes], b: list[bytes], dim: int) -> np.ndarray:
    """The inner products of pairs, exact, cut to 64 bits."""
    out = np.empty(len(a), dtype=np.int64)
    shape = np.array([len(x) * (WIDE * dim + 1) + len(y) for x, y in zip(a, b, strict=True)])
    for s in np.unique(shape):
        at = np.flatnonzero(shape == s)
        x, y = _integers([a[i] for i in at], dim), _integers([b[i] for i in at], dim)
        if x.dtype != object and y.dtype != object and float(np.abs(x).max()) * float(np.abs(y).max()) * dim < 2.0**62:
            out[at] = np.einsum("ij,ij->i", x, y)
        else:
            for i, p, q in zip(at, x.tolist(), y.tolist(), strict=True):
                out[i] = max(SCORE_MIN, min(SCORE_MAX, sum(u * v for u, v in zip(p, q, strict=True))))
    return out


def steps_of(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The STEPS points of each dimension, in order, moved to the means of what is nearest to them (dimensions x STEPS)."""
    q = (np.arange(STEPS) + 0.5) / STEPS
    points = np.quantile(sample, q, axis=0).T
    for _ in range(rounds):
        near = _codes(sample, points)
        for s in range(STEPS):
            mine = near == s
            n = mine.sum(axis=0)
            mean = np.where(mine, sample, 0.0).sum(axis=0) / np.maximum(n, 1)
            points[:, s] = np.where(n > 0, mean, points[:, s])
        points.sort(axis=1)
    return points


def _codes(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The number of the step nearest to each component."""
    edges = (points[:, 1:] + points[:, :-1]) / 2
    out = np.zeros(x.shape, dtype=np.uint8)
    for s in range(STEPS - 1):
        out += x > edges[:, s]
    return out


def pack_codes(codes: np.ndarray) -> list[bytes]:
    """Two codes of four bits in a byte, rows apart."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], axis=1)
    both = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
    return [r.tobytes() for r in both]


def unpack(rows: list[bytes], points: np.ndarray) -> np.ndarray:
    """The approximate vectors that packed rows stand for."""
    dim = len(points)
    both = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    codes = np.stack([both & 15, both >> 4], axis=2).reshape(len(rows), -1)[:, :dim]
    return points[np.arange(dim), codes]


def approximations(x: np.ndarray, points: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The packed codes of vectors and their distances from what the codes stand for."""
    codes = _codes(x, points)
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.linalg.norm(x - points[np.arange(len(points)), codes], axis=1)
    return pack_codes(codes), np.nan_to_num(apart, nan=np.inf, posinf=np.inf) * (1 + SLACK)


def upper_bounds(queries: np.ndarray, near: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Bounds from above of all scores (queries x candidates); a query of zeros has bounds of exactly zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.linalg.norm(queries, axis=1)
        reach = np.linalg.norm(near, axis=1) * SLACK + apart
        out = queries @ near.T
        out += np.where(size[:, None] > 0, size[:, None] * reach, 0.0)
    return np.nan_to_num(out, nan=np.inf, posinf=np.inf, neginf=-np.inf)


# ---- plans ----


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(dim, whole, ids, asks, cid): distinct integer vectors, their k + 1 smallest ids and how many of their rows ask."""
    nth = F.row_number().over(Window.partitionBy("dim", "whole").orderBy("vec_id"))
    ids = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("dim", "whole").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asks = rows.groupBy("dim", "whole").agg(F.count_if("query").alias("asks"))
    return cut(ids.join(asks, ["dim", "whole"]).withColumn("cid", F.monotonically_increasing_id()))


def _fitted(classes: DataFrame) -> dict[int, np.ndarray]:
    """The steps by number of dimensions, from SAMPLE classes at most, in the order of a hash."""
    by: dict[int, list[bytes]] = {}
    for r in classes.orderBy(F.xxhash64("dim", "whole")).select("dim", "whole").limit(SAMPLE).collect():
        by.setdefault(r["dim"], []).append(bytes(r["whole"]))
    return {d: steps_of(np.clip(_floats(rows, d), -1e100, 1e100)) for d, rows in by.items()}


def _scan(points: dict[int, np.ndarray], keep):
    """For cogroup().applyInPandas: bounds of a block of queries over a block of the file; keep() picks what goes on."""

    def run(asked: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(file):
            dim = int(file["dim"].iloc[0])
            file = file.sort_values("cid")
            steps = points.get(dim, np.zeros((dim, STEPS)))
            first, cid, apart = file["first"].to_numpy(), file["cid"].to_numpy(), file["apart"].to_numpy()
            near = unpack([bytes(x) for x in file["code"]], steps)
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                bounds = upper_bounds(_floats([bytes(x) for x in part["whole"]], dim), near, apart)
                for i, (row, q) in enumerate(zip(bounds, part["cid"], strict=True)):
                    hit = keep(row, first, part, i)
                    out.append(pd.DataFrame({"q": q, "c": cid[hit], "first": first[hit], "upper": row[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "c": [], "first": [], "upper": []})

    return run


def _best_bounds(n: int):
    """Picks the n highest bounds, ties to the smaller id."""

    def keep(row: np.ndarray, first: np.ndarray, part: pd.DataFrame, i: int) -> np.ndarray:
        if len(row) > n:
            least = np.partition(row, len(row) - n)[len(row) - n]
            at = np.flatnonzero(row >= least)
        else:
            at = np.arange(len(row))
        return at[np.lexsort((first[at], -row[at]))][:n]

    return keep


def _could_count(row: np.ndarray, first: np.ndarray, part: pd.DataFrame, i: int) -> np.ndarray:
    """Picks whatever may come before the k-th exact score and its id."""
    score, rival = float(part["score"].iloc[i]), int(part["rival"].iloc[i])
    return np.flatnonzero((row > score) | (row == score) & (first <= rival))


BOUNDS = "q long, c long, first long, upper double"


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(q, c, first, score) of pairs (q, c, first): both exact vectors are fetched by their class numbers."""
    side = lambda name, own: classes.select(F.col("cid").alias(name), F.col("whole").alias(own), *(["dim"] if own == "x" else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                scores = exact_scores([bytes(v) for v in part["x"]], [bytes(v) for v in part["y"]], int(dim))
                yield part[["q", "c", "first"]].assign(score=scores)

    both = pairs.select("q", "c", "first").join(side("c", "x"), "c").join(side("q", "y"), "q")
    return both.mapInPandas(run, "q long, c long, first long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, ahead: int = 64, query_block: int = 4096, block: int = 32_768, with_reads: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row that fulfils is_query (a condition).

    with_reads adds n_read, the exact vectors read for the query. Blocks of queries meet blocks of the file, one pair a task; of a
    pair go on `ahead` + 1 bounds a query in the first scan, and only what may still count in the second.
    """
    rows = valid_vectors(vectors.select("vec_id", "embedding", is_query.alias("query")).where("vec_id is not null"))

    def integers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "query": b["query"].fillna(False).astype(bool), "dim": b["embedding"].map(len), "whole": b["embedding"].map(lambda v: whole_bytes(v, scale))})

    rows = cut(rows.mapInPandas(integers, "vec_id long, query boolean, dim int, whole binary"))
    classes = classes_of(rows, k)
    points = _fitted(classes)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                steps = points.get(int(dim), np.zeros((int(dim), STEPS)))
                code, apart = approximations(_floats([bytes(x) for x in part["whole"]], int(dim)), steps)
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "dim": part["dim"].to_numpy(), "first": part["first"].to_numpy(), "code": code, "apart": apart})

    file = cut(classes.select("cid", "dim", F.col("ids")[0].alias("first"), "whole").mapInPandas(codes, "cid long, dim int, first long, code binary, apart double"))
    n = classes.agg(F.count("*").alias("n"), F.count_if(F.col("asks") > 0).alias("q")).first()
    # as many pairs of blocks as keep a small cluster busy; how many doesn't change the result
    blocks = max(1, -(-n["n"] // block))
    query_blocks = max(1, -(-n["q"] // query_block), min(16 // blocks, -(-n["q"] // 64)))
    spread = F.xxhash64("cid")

    def scan(asked: DataFrame, keep) -> DataFrame:
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = asked.withColumn("qb", F.pmod(spread, F.lit(query_blocks)).cast("int")).withColumn("cb", every(blocks))
        right = file.withColumn("cb", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("qb", every(query_blocks))
        return left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInPandas(_scan(points, keep), BOUNDS)

    asked = classes.where("asks > 0").select("cid", "dim", "whole")
    by_bound = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "first", "c"))
    best = cut(scan(asked, _best_bounds(ahead + 1)).withColumn("nth", by_bound).where(F.col("nth") <= ahead + 1))
    # classes come by (score, smallest id), so the first k + 1 hold the first k + 1 rows, one of which may be the query's own
    by_score = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "c"))
    read = cut(_exact(best.where(F.col("nth") <= ahead), classes))
    kth = read.withColumn("nth", by_score).where(F.col("nth") == k + 1).select("q", "score", F.col("first").alias("rival"))
    after = best.where(F.col("nth") == ahead + 1).select("q", "upper", "first")
    open_ = after.join(kth, "q", "left").where("score is null or upper > score or (upper = score and first <= rival)")
    open_ = cut(open_.select("q", F.coalesce("score", F.lit(SCORE_MIN)).alias("score"), F.coalesce("rival", F.lit(SCORE_MAX)).alias("rival")))
    if not open_.isEmpty():
        again = asked.join(open_.withColumnRenamed("q", "cid"), "cid")
        read = cut(read.union(_exact(scan(again, _could_count), classes)).distinct())
    found = read.withColumn("nth", by_score).where(F.col("nth") <= k + 1)
    # the rows of these classes, best first
    rows_of = found.join(classes.select(F.col("cid").alias("c"), "ids"), "c").select("q", "c", "score", F.explode("ids").alias("vec_id"))
    by_row = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "c"))
    hit = F.struct(by_row.alias("nth"), "vec_id", "score", (F.col("c") == F.col("q")).alias("own"))
    hits = rows_of.select("q", hit.alias("hit")).where(F.col("hit.nth") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    if with_reads:
        hits = hits.join(read.groupBy("q").agg(F.count("*").alias("n_read")), "q")
    # rows that ask may be many in one class: its hits are copied for every thousand of them
    salts = F.ceil(F.col("asks") / 1000).cast("int")
    lists = classes.where("asks > 0").withColumnRenamed("cid", "q").join(hits, "q").select(
        "dim", "whole", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), salts.alias("salts"), "hits", *(["n_read"] if with_reads else []))
    many = classes.where("asks > 1000").select("dim", "whole", salts.alias("many"))
    asking = rows.where("query").join(many, ["dim", "whole"], "left")
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("many", F.lit(1))).cast("int")).select("dim", "whole", "salt", "vec_id")
    # of its class a row drops one entry with its own id: itself
    me = F.col("query_id")
    own = F.array_position(F.transform("hits", lambda h: h.own & (h.vec_id == me)), True)
    others = F.filter("hits", lambda h, i: i + 1 != own)
    out = asking.withColumnRenamed("vec_id", "query_id").join(lists, ["dim", "whole", "salt"]).withColumn("others", F.slice(others, 1, k))
    out = out.select("query_id", F.posexplode("others").alias("at", "hit"), *(["n_read"] if with_reads else []))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score", *(["n_read"] if with_reads else []))
