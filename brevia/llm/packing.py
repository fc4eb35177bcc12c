"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become token ids of a public tokenizer and an end id; only those longer than a sequence are cut, the remainder
first. Packing runs in levels. A level deals pieces by hash into shards of about `shard_items` pieces; several islands evolve
packings of each shard (Falkenauer's grouping scheme: crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold the same pieces, and best-fits what they displaced), pass their elites to the next island
between epochs, and the best elite of a shard is kept. Pieces of the bins that stay poorly filled meet in fewer shards on
the next level, so a partly filled last bin per shard doesn't add up.

Defined results: a null or empty text is its end id alone; repeated rows and null ids are documents of their own; an
empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, cut

#: Words whose ids a worker remembers, about 150 bytes each; more are encoded afresh.
REMEMBERED = 400_000


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to what the tokenizer's library gives.

    The pre-tokenizer never joins what a single space parts, so a text is cut at its spaces and each word's ids, with the
    space before it, are remembered. Where blanks meet (an empty word or one with a blank at its end) the whole text is
    encoded at once, and so is a text that holds a special token's string.
    """

    def __init__(self, name: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = lambda text: np.array(plain.encode_ordinary(text), dtype="<u4").tobytes()
        encode = self.plain

        class Words(dict):
            def __missing__(self, word: str) -> bytes | None:
                loose = not word or word[0].isspace() or word[-1].isspace()
                ids = None if loose else encode(" " + word)
                if len(self) < REMEMBERED:
                    self[word] = ids
                return ids

        self.words = Words()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *words = text.split(" ")
        if head and head[-1].isspace():
            return self.plain(text)
        try:
            return self.plain(head) + b"".join(map(self.words.__getitem__, words))
        except TypeError:  # a None: blanks meet
            return self.plain(text)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One per worker process."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: item (unique), doc_id, the columns of PIECE and, if asked for, ids (little-endian, binary)."""
    schema = T.StructType([T.StructField("item", T.LongType()), docs.schema["doc_id"], *T.StructType.fromDDL(PIECE).fields])
    last = np.array([end_id], dtype="<u4").tobytes()
    made = T.StructType([schema["item"], *T.StructType.fromDDL(PIECE).fields])
    full = schema.add("ids", "binary") if with_ids else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, item = encoder(tokenizer).ids, TaskContext.get().partitionId() << 36
        for b in batches:
            rows, own, ids = [], [], []
            for at, text in enumerate(b.column("text").to_pylist()):
                data = encode(text or "") + last
                n = len(data) // 4
                start, length = 0, n % capacity or capacity
                piece = 0
                while start < n:
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((item, piece, start, length, zlib.crc32(part)))
                    own.append(at)
                    if with_ids:
                        ids.append(part)
                    item, piece, start, length = item + 1, piece + 1, start + length, capacity
            if rows:
                x = arrow_batch(made, list(zip(*rows, strict=True)))
                extra = [pa.array(ids, type=pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([x.column(0), b.column("doc_id").take(pa.array(own)), *x.columns[1:], *extra], names=full.names)

    return docs.select("doc_id", "text").mapInArrow(run, full)


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Puts items in this order each into the fullest bin that holds it, or a new one. bins is added to."""
    by: dict[int, list[int]] = {}
    mask = 0
    for k, b in enumerate(bins):
        room = capacity - sum(lengths[i] for i in b)
        by.setdefault(room, []).append(k)
        mask |= 1 << room
    for i in order:
        need = lengths[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            same = by[room]
            k = same.pop()
            if not same:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        by.setdefault(room - need, []).append(k)
        mask |= 1 << (room - need)
    return bins


def fitness(bins: list[list[int]], lengths: list[int]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """b with some of a's well-filled bins put in whole; what they displace is best-fitted, longest first."""
    full = sorted(a, key=lambda x: -sum(lengths[i] for i in x))[: max(1, 2 * len(a) // 3)]
    injected = rng.sample(full, max(1, len(full) // 2))
    held = {i for x in injected for i in x}
    child, displaced = [list(x) for x in injected], []
    for x in b:
        if held.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in held]
    worst = max(range(len(child)), key=lambda k: capacity - sum(lengths[i] for i in child[k]))
    displaced += child.pop(worst)  # the mutation: the emptiest bin is dealt anew
    return best_fit(sorted(displaced, key=lambda i: (-lengths[i], i)), lengths, capacity, child)


def evolve(lengths: list[int], capacity: int, elites: list[list[list[int]]], seed: int, population: int = 6, generations: int = 40) -> list[list[int]]:
    """The fittest packing after some generations; stops at once where no fewer bins are possible."""
    least = -(-sum(lengths) // capacity)
    rng = random.Random(seed)
    pool = [best_fit(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), lengths, capacity, []), *elites]
    while len(pool) < population:
        if any(len(x) == least for x in pool):
            break
        noise = [x * rng.uniform(0.8, 1.25) for x in lengths]
        pool.append(best_fit(sorted(range(len(lengths)), key=lambda i: -noise[i]), lengths, capacity, []))
    rate = lambda x: fitness(x, lengths)
    pool.sort(key=rate, reverse=True)
    for _ in range(generations):
        if len(pool[0]) == least or len(pool) < 2:
            break
        a, b = rng.sample(pool, 2)
        child = crossover(a, b, lengths, capacity, rng)
        if rate(child) > rate(pool[-1]):
            pool[-1] = child
            pool.sort(key=rate, reverse=True)
    return pool[0]


SOLVED = "shard long, island int, item long, length long, bin int, offset long, room long"


def _solver(capacity: int, level: int, epoch: int):
    """For applyInPandas: evolves the packing of a shard from the elites that came, and returns the fittest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "came"], kind="stable")
        items = rows.drop_duplicates("item")
        at = {x: k for k, x in enumerate(items["item"])}
        lengths = items["length"].astype(int).tolist()
        elites: dict[int, dict[int, list[int]]] = {}
        for came, item, bin_ in zip(rows["came"], rows["item"], rows["bin"], strict=True):
            if bin_ >= 0:
                elites.setdefault(came, {}).setdefault(bin_, []).append(at[item])
        shard, island = int(rows["shard"].iloc[0]), int(rows["island"].iloc[0])
        seed = zlib.crc32(f"{level} {epoch} {shard} {island}".encode())
        best = evolve(lengths, capacity, [list(e.values()) for _, e in sorted(elites.items())], seed)
        names, out = items["item"].tolist(), []
        for k, b in enumerate(best):
            offset, room = 0, capacity - sum(lengths[i] for i in b)
            for i in b:
                out.append((shard, island, names[i], lengths[i], k, offset, room))
                offset += lengths[i]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SOLVED.split(", ")])

    return run


def pack(items: DataFrame, capacity: int = 2048, shard_items: int = 1024, islands: int = 3, epochs: int = 2, levels: int = 4) -> DataFrame:
    """Places items (item long unique, length long up to capacity): (item, sequence_id, offset).

    sequence_id is the item at offset 0. A bin with more than a 64th of its room free is poor: its items go on to the next
    level, until one shard holds them all or `levels` is reached.
    """
    done = items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pending = items.where(F.col("length") < capacity).select("item", "length")
    for level in range(levels):
        n = pending.count()
        if not n:
            break
        shards = -(-n // shard_items)
        rows = pending.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).cast("long")).withColumns(
            {"island": F.explode(F.sequence(F.lit(0), F.lit(islands - 1))), "came": F.lit(0), "bin": F.lit(-1)}
        )
        for epoch in range(epochs):
            solved = rows.groupBy("shard", "island").applyInPandas(_solver(capacity, level, epoch), SOLVED)
            # each elite stays and also goes to the next island; after the last epoch all meet on one
            last = epoch == epochs - 1
            goes = F.array(F.lit(0)) if last else F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            rows = solved.select("shard", F.explode(goes).alias("to"), F.col("island").alias("came"), "item", "length", "bin")
            rows = rows.withColumnRenamed("to", "island")
        solved = cut(rows.groupBy("shard", "island").applyInPandas(_solver(capacity, level, epochs), SOLVED))
        heads = solved.where("offset = 0").select("shard", "bin", F.col("item").alias("sequence_id"))
        placed = solved.join(heads, ["shard", "bin"]).select("item", "length", "sequence_id", "offset", "room")
        if shards == 1 or level == levels - 1:
            return done.union(placed.select("item", "sequence_id", "offset"))
        done = done.union(placed.where(F.col("room") <= capacity // 64).select("item", "sequence_id", "offset"))
        pending = solved.where(F.col("room") > capacity // 64).select("item", "length")
    return done


def packed_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = False, **options) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    made = cut(pieces(docs, capacity, tokenizer, end_id, with_ids))
    places = pack(made.select("item", "length"), capacity, **options)
    return made.join(places, "item").drop("item")
