"""Mixing sources to target weights by a low-discrepancy schedule.

Point t of the golden-ratio sequence, as a fixed-point fraction of 2**64, falls into one of the sources' intervals, which follow
one another and are as wide as the blocks that each source has to give: slot t belongs to that source. Slots are ranked per source, and
rank r takes the r-th block of the source's shuffled words, where all blocks hold equally many words (the last of a round may be short);
ranks beyond the blocks start the next round. How often the sequence visits an interval up to any t is a sum of floors, found in
logarithmic time, and from one visit to the next of an interval it takes one of three numbers of steps. So each source's slots
are listed without those of the others, a stretch of ranks at a time, and no slot is made that isn't used.

Sources are rows: targets come from a few sums over all of them, and no list of sources reaches the driver or a task.

Defined results: a null text has no words; rows with no words are never taken; a null source is a source of its own, the last
one; repeated rows and null ids are rows like others; no words at all gives targets of zero; an empty table an empty
result; a very long text is one row that spans many blocks. Columns of the input with names used here are carried
unharmed by mixed_documents() and not read by mixed_words().
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, hashable

#: 2**64 divided by the golden ratio, odd.
STEP = 0x9E3779B97F4A7C15
WHOLE = 1 << 64
#: Sources up to this number are broadcast, at most some MB; more are joined, dealt over SALTS.
FEW_SOURCES, SALTS = 20_000, 64


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of floor((a*i + b) / m) for i from 0 to n - 1."""
    total = 0
    while n:
        total += (a // m) * (n * (n - 1) // 2) + (b // m) * n
        a, b = a % m, b % m
        n, b = divmod(a * n + b, m)
        a, m = m, a
    return total


def visits(n: int, low: int, high: int) -> int:
    """How many of the points t * STEP mod 2**64, for t from 1 to n, lie in [low, high)."""

    def below(x: int) -> int:
        # floor((y + 2**64 - x) / 2**64) is 1 from x up and 0 below it
        return n - (floor_sum(n, WHOLE, STEP, STEP + WHOLE - x) - floor_sum(n, WHOLE, STEP, STEP))

    return below(high) - below(low)


def first_hit(a: int, m: int, low: int, high: int) -> int:
    """The least t >= 0 with low <= a * t mod m <= high, for 0 <= low <= high < m; -1 if there is none."""
    a %= m
    if low == 0:
        return 0
    if a == 0:
        return -1
    if 2 * a > m:
        a, low, high = m - a, m - high, m - low
    t = -(-low // a)
    if a * t <= high:
        return t
    # a steps over [low, high]: after how many turns of m does it not
    turns = first_hit(a - m % a, a, low % a, high % a) if low % a <= high % a else -1
    if turns < 0:
        return -1
    return -(-(low + m * turns) // a)


class Visits:
    """The visits of the sequence to an interval [low, high), in order."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.length = low, high - low
        # the shortest ways that end a little above and a little below where they start
        self.up = first_hit(STEP, WHOLE, 1, self.length - 1) if self.length > 1 else 0
        self.down = first_hit(WHOLE - STEP, WHOLE, 1, self.length - 1) if self.length > 1 else 0
        self.rise, self.fall = self.up * STEP % WHOLE, -self.down * STEP % WHOLE

    def nth(self, rank: int) -> int:
        """The t of a visit, counted from 0: the least t up to which there are rank + 1 of them."""
        high = 1
        while visits(high, self.low, self.low + self.length) <= rank:
            high *= 2
        low = high // 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if visits(mid, self.low, self.low + self.length) > rank else (mid, high)
        return high

    def times(self, rank: int, n: int) -> list[int]:
        """The t of n visits from a rank on."""
        t, out = self.nth(rank), []
        at = (t * STEP - self.low) % WHOLE
        room = self.length - self.rise
        for _ in range(n):
            out.append(t)
            if at < room:
                t, at = t + self.up, at + self.rise
            elif at >= self.fall:
                t, at = t + self.down, at - self.fall
            else:
                t, at = t + self.up + self.down, at + self.rise - self.fall
        return out


def level(sources: DataFrame, share: float, most: float) -> float:
    """Words per weight at which sources that aren't full are filled: found as the contract has it, with one sum a round."""
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    full: tuple = (0, 0)
    while True:
        brim = most * F.col("source_size")
        left = sources.agg(F.sum("weight")).first()[0] if not full[0] else full[2]
        now = (total - (full[1] if full[0] else 0)) / left if left else 0.0
        r = sources.agg(
            F.count_if(brim <= F.col("weight") * now).alias("n"), F.coalesce(F.sum(F.when(brim <= F.col("weight") * now, brim)), F.lit(0.0)).alias("words"),
            F.coalesce(F.sum(F.when(brim > F.col("weight") * now, F.col("weight"))), F.lit(0.0)).alias("left"),
        ).first()
        if r["n"] == full[0] or not r["left"]:
            return now if r["left"] else float("inf")
        full = (r["n"], r["words"], r["left"])


def running(rows: DataFrame, value, out: str) -> DataFrame:
    """rows, which are in order over their partitions, with the sum of value over all rows before each one.

    Sums by partition come to the driver; the running sum inside a partition is a window's.
    """
    placed = rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    sums = sorted(placed.groupBy("_p").agg(F.sum(value).alias("n")).collect(), key=lambda r: r["_p"])
    before, at = [], 0
    for r in sums:
        before += [F.lit(r["_p"]), F.lit(at)]
        at += r["n"]
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.try_element_at(F.create_map(*before), F.col("_p")) if before else F.lit(0)
    return placed.withColumn(out, (ahead + F.coalesce(inside, F.lit(0))).cast("long")).drop("_p", "_i")


def sources_of(slim: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """A row per source: skey, source_size, rows, si (its number in order), target, and its part of the schedule.

    blocks: those of one round; need: ranks to take; rest: words of the last round; ahead, width: its interval, in units of which
    there are `units`.
    """
    found = slim.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # s and a source's name, or a single t for the null one: in order of code points with null last
    numbered = cut(running(cut(found.orderBy("skey")), F.lit(1), "si"))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    numbered = cut(numbered.withColumn("weight", F.element_at(ws, (F.col("si") % len(weights) + 1).cast("int"))))
    at = level(numbered, share, most)
    brim = most * F.col("source_size")
    target = brim.cast("double") if at == float("inf") else F.least(brim.cast("double"), F.col("weight") * at)
    words, size = F.floor("target"), F.greatest(F.lit(1), F.col("source_size"))
    rows = numbered.withColumn("target", target).withColumns({"blocks": F.ceil(F.col("source_size") / block), "rest": words % size, "turns": F.floor(words / size)})
    rows = rows.withColumn("need", F.when(F.col("source_size") > 0, F.col("turns") * F.col("blocks") + F.ceil(F.col("rest") / block)).otherwise(0))
    # one more than needed: the sequence may come up to two visits late to a narrow interval
    rows = running(cut(rows.withColumn("width", F.when(F.col("need") > 0, F.col("need") + 1).otherwise(0)).orderBy("si").drop("weight", "turns")), F.col("width"), "ahead")
    rows = cut(rows)
    return rows.withColumn("units", F.lit(rows.agg(F.coalesce(F.sum("width"), F.lit(0))).first()[0]))


SLOTS = "si long, slot long, rank long, round long, block long, take long"


def slot_frame(sources: DataFrame, block: int, chunk: int = 1 << 14) -> DataFrame:
    """The slots: (si, slot, rank, round, block, take): source, place in the mix, rank, its round and block, words taken of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                low, high = (x * WHOLE // r["units"] for x in (r["ahead"], r["ahead"] + r["width"]))
                first = r["part"] * chunk
                n = min(chunk, r["need"] - first)
                times = Visits(low, high).times(first, n)
                ranks = range(first, first + n)
                turn, at = [k // r["blocks"] for k in ranks], [k % r["blocks"] for k in ranks]
                take = [min(block, r["source_size"] - x * block) for x in at]
                if r["rest"] and first + n == r["need"]:
                    take[-1] = r["rest"] - at[-1] * block
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([r["si"]] * n, times, ranks, turn, at, take)], names=[x.split()[0] for x in SLOTS.split(", ")])

    parts = sources.where("need > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1) / chunk))))
    parts = parts.select("si", "source_size", "blocks", "need", "rest", "ahead", "width", "units", "part").repartition("si", "part")
    return parts.mapInArrow(run, SLOTS)


def mix(slim: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 256, bucket_rows: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """(placed, uses) of rows (skey, order, size, ...), which should be cheap to read again.

    placed: slim with source_size, target, si and start, the row's first word in its source's shuffled order. uses: (si, start, slot, round,
    words), one row per stretch of a document in a slot. A row's place comes from its hash: a source is cut into hash buckets of
    about bucket_rows rows, whose sizes are summed before, so only a bucket is sorted by one task, however large the source is.
    """
    sources = sources_of(slim, weights, share, most, block)
    few = sources.count() <= FEW_SOURCES
    facts = sources.select("skey", "si", "source_size", "target", F.ceil(F.col("rows") / bucket_rows).alias("buckets"))
    if few:
        rows = slim.join(F.broadcast(facts), "skey")
    else:
        salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = slim.withColumn("salt", F.pmod("order", F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"]).drop("salt")
    # the first bits deal buckets, so that a bucket's rows are in the order of the whole hash
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("buckets")))
    sums = rows.groupBy("si", "bucket").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("si").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("si", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("si", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, ["si", "bucket"])
    placed = cut(placed.withColumn("start", F.col("inside") + F.col("ahead")).drop("skey", "inside", "ahead", "bucket", "buckets", "order"))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("si", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    # the planner can't tell how many slots there are: they must not be broadcast
    slots = slot_frame(sources, block).hint("merge")
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("end"), F.col("block") * block + F.col("take"))
    uses = pieces.join(slots, ["si", "block"]).withColumn("words", high - low).where("words > 0").select("si", "start", "slot", "round", "words")
    return placed, uses


def _slim(docs: DataFrame, order, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(BLANKS)), F.lit(0)).cast("long")
    skey = F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return cut(docs.select(skey.alias("skey"), order.alias("order"), size.alias("size"), *more))


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken, the words the mix takes of it, and first_slot.

    Texts are read once. first_slot is the first slot of the schedule that the document stands in, null if none.
    """
    slim = _slim(docs, F.xxhash64("doc_id", "source", "text"), "doc_id")
    placed, uses = mix(slim, **options)
    taken = uses.groupBy("si", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumnRenamed("start", "key")
    # only documents with words own a start; those without are dealt out, not joined
    found = placed.where("size > 0").join(taken, [placed["si"] == taken["si"], placed["start"] == taken["key"]], "left")
    out = found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long"), F.lit(None).cast("long"))
    return out.union(none)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each document once for every round in which the mix takes at least half of its words.

    Texts are read for their words, and once more, hashed, to be joined to the number of their copies.
    """
    # other columns get names of their own meanwhile, so that none is taken for one made here
    names = {c: c if c in ("source", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    order = F.xxhash64(*hashable(docs))
    placed, uses = mix(_slim(docs, order, order.alias("row")), **options)
    rounds = uses.groupBy("si", "start", "round").agg(F.sum("words").alias("words"))
    rows = placed.where("size > 0")
    chosen = rounds.join(rows, ["si", "start"]).where(F.col("words") * 2 >= F.col("size")).groupBy("row").agg(F.count("*").alias("n"))
    # repeated rows share a hash: each gets its part of the copies, and what is left over goes to the first ones
    times = placed.groupBy("row").agg(F.count("*").alias("rows"))
    counted = cut(chosen.join(times, "row").select(F.col("row").alias("order"), "n", "rows"))
    found = docs.withColumn("order", order).join(counted, "order")
    copies = F.floor(F.col("n") / F.col("rows"))
    single = found.where("rows = 1").withColumn("copies", F.col("n"))
    out = single
    if not counted.where("rows > 1").isEmpty():
        many = found.where("rows > 1").withColumn("nth", F.row_number().over(Window.partitionBy("order").orderBy("text")))
        out = single.unionByName(many.withColumn("copies", (copies + (F.col("nth") <= F.col("n") % F.col("rows")).cast("int")).cast("long")).drop("nth"))
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(n).alias(c) for c, n in names.items()))
