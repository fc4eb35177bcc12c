"""Near-duplicate vectors: spherical k-means cells, cosine products in blocks, one representative kept.

Equal vectors of a label are one class first, with a count. Centroids are fitted to a bounded sample; every class has the
cell of its nearest centroid as home and also visits each other cell in which a vector within the angle may live: the
angle to the border between two cells, asin((y.c - y.c') / |c - c'|), bounds that from below, so no link is lost
whatever the centroids are. In a cell, home classes are compared with home and visiting ones, block by block.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id,
link with nothing and are kept as they are; vectors of different lengths don't link; repeated rows count as vectors; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .topk import valid_vectors

#: Vectors that k-means sees at most.
SAMPLE = 8192
#: Rounding of angles: visits are wider by this much.
SLACK = 1e-9


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def _unit(embeddings) -> np.ndarray:
    x = np.array([list(e) for e in embeddings], dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(classes: DataFrame, k: int) -> dict[int, np.ndarray]:
    """Centroids by number of dimensions, from at most SAMPLE vectors in the order of a hash."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    return {d: spherical_k_means(_unit(v), max(1, min(k, len(v)))) for d, v in by.items()}


def cells(classes: DataFrame, centers: dict[int, np.ndarray], angle: float) -> DataFrame:
    """(label, dim, cell, home, rep, w, embedding): a row for the home of each class and one for each visit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                c = centers.get(int(dim))
                n = len(part)
                if c is None or len(c) == 1:
                    yield part.assign(cell=0, home=True)
                    continue
                near = _unit(part["embedding"]) @ c.T
                own = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[own]
                gap = near[np.arange(n), own][:, None] - near
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = np.where(apart > 1e-6, np.arcsin(np.clip(gap / apart, 0, 1)), 0.0)
                row, cell = np.nonzero(border <= angle + SLACK)
                out = part.iloc[row].assign(cell=cell, home=cell == own[row])
                for at in range(0, len(out), 20_000):
                    yield out.iloc[at : at + 20_000]

    schema = "label int, dim int, rep long, w long, embedding array<float>, cell int, home boolean"
    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("label", "dim", "rep", "w", "embedding").mapInPandas(run, schema.replace("array<float>", kind).replace("label int", f"label {classes.schema['label'].dataType.simpleString()}"))


LINKS = "a long, b long, n long"


def block_links(rows: pd.DataFrame, threshold: float, both: bool) -> pd.DataFrame:
    """Compares the two sides of a block: (class, null, weight linked) and a spanning forest (class, class, null).

    both: the other side gets its counts, too.
    """
    rows = rows.sort_values(["side", "rep"])
    side = rows["side"].to_numpy()
    x, rep, w = _unit(rows["embedding"]), rows["rep"].to_numpy(np.int64), rows["w"].to_numpy(np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right) and rows["same"].iloc[0]
    right = left if alone else right
    counts, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        a, b = np.nonzero(x[part] @ x[right].T >= threshold)
        a, b = part[a], right[b]
        a, b = a[a != b], b[a != b]
        np.add.at(counts, a, w[b])
        if both and not alone:
            np.add.at(counts, b, w[a])
        while True:
            p, q = root[a], root[b]
            if (p == q).all():
                break
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root != root[root]).any():
                root = root[root]
    got, linked = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(rows)))
    return pd.DataFrame(
        {
            "a": np.concatenate([rep[got], rep[linked]]),
            "b": pd.array([*([None] * len(got)), *rep[root[linked]]], dtype="Int64"),
            "n": pd.array([*counts[got], *([None] * len(linked))], dtype="Int64"),
        }
    )


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = 1024, cell_size: int = 2048, most_cells: int = 256) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vectors = vectors.select("vec_id", "label", "embedding")
    fine = valid_vectors(vectors.where("vec_id is not null and label is not null"))
    fine = fine.where(F.exists("embedding", lambda v: v != 0))
    classes = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"))
    # rep names a class; different vectors may share an id
    classes = cut(classes.withColumns({"dim": F.size("embedding"), "rep": F.monotonically_increasing_id()}))
    n = classes.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).first()
    k = max(1, min(most_cells, round(n["n"] / max(1, n["labels"]) / cell_size)))
    homes = cut(cells(classes, centroids_of(classes, k), math.acos(threshold)))
    # blocks of at most `block` classes on average, by hash, counted per label and cell
    key = ["label", "dim", "cell"]
    sizes = homes.groupBy(key).agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("home") / block)).cast("int").alias("own"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("guests")
    )
    rows = homes.join(sizes, key).withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("own")).otherwise(F.col("guests"))).cast("int"))
    all_ = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    inner = rows.where("home").withColumn("to", F.explode(all_("own"))).select(
        *key, F.lit(True).alias("inner"), F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"),
        F.when(F.col("at") <= F.col("to"), 0).otherwise(1).alias("side"), (F.col("at") == F.col("to")).alias("same"), "rep", "w", "embedding")
    outer = rows.withColumn("to", F.explode(F.when(F.col("home"), all_("guests")).otherwise(all_("own")))).select(
        *key, F.lit(False).alias("inner"), F.when(F.col("home"), F.col("at")).otherwise(F.col("to")).alias("i"), F.when(F.col("home"), F.col("to")).otherwise(F.col("at")).alias("j"),
        F.when(F.col("home"), 0).otherwise(1).alias("side"), F.lit(False).alias("same"), "rep", "w", "embedding")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return block_links(rows, threshold, bool(rows["inner"].iloc[0]))

    found = cut(inner.union(outer).groupBy(*key, "inner", "i", "j").applyInPandas(run, LINKS))
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    comps = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    rooted = cut(classes.join(counts, "rep", "left").join(comps, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    summary = rooted.join(least, "root").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    # written, so that Spark can split the partition of a vector with very many copies
    linked = fine.join(cut(summary), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    # what is not fine, told by the same conditions
    rest = vectors.where(~F.coalesce(_is_fine(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _is_fine():
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists(x, lambda v: v != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & some
