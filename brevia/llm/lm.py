"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Every word has a class: the most frequent ones are classes of their own, any other word, seen or not, belongs to the class of its last
two bytes (the common endings have a class each, the others share some by hash). A class after two others scores
exp(r.(c1*q1 + c2*q2) + b), where q and r are the vectors of context and target, and c1, c2 diagonal matrices by position (Mnih and
Teh, 2012). Since that is a product of one factor per context class, the normaliser of all pairs of context classes is one
product of two matrices, so class probabilities are exact. In its class k of endings a word has probability (1 - u) c / n + u s: c of the n
training tokens of the class, and s, what a spelling model gives it: an ending of the class, then the bytes before it, each after the
next one, to the start of the word. u is the share of tokens of the class whose word is seen once (Good and Turing). So all words
that can be written have probabilities that sum to 1, but for what spelling gives to words with a class of their own.

Training reads every training token: tokens become class numbers once and are dealt into shards by hash, as many as the tokens ask
for; in each of a few rounds, every shard of that round is run over from the same start, and parameters are averaged by tokens. Nothing
depends on how Spark partitions the table. Counts cover all training tokens and the whole vocabulary; the table of counts and the number of shards
grow with the input, the vectors don't.

Defined results: a null or empty text is its end alone; repeated rows are scored each; a null id is learned from; without
training tokens every class is equally likely and words are spelled; an empty table gives an empty result; very long texts are read
whole, one at a time; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batch, ascii_words, crc32_mod, cut

#: The end of a text, as a token. No word is empty.
END = b""
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
SLICE = 4096
#: What stands before the first byte of a word; blanks and capitals are in no word.
START = 256
LETTERS = np.array([b for b in range(256) if b not in b" \t\n\v\f\r" and not 65 <= b <= 90])
_BIGRAMS = 1 << 17


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words with counts, the end of a text and then the most frequent first; the first `own` are classes."""

    words: list[bytes]
    counts: np.ndarray
    own: int
    tokens: int
    distinct: int


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of the texts, the end of a text among them as the empty word."""
    schema = T.StructType.fromDDL("word string, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(ascii_words(text))
                seen[END] += 1
                if len(seen) > HELD:
                    yield arrow_batch(schema, [[w.decode() for w in seen], list(seen.values())])
                    seen.clear()
        if seen:
            yield arrow_batch(schema, [[w.decode() for w in seen], list(seen.values())])

    return docs.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, own: int, frequent: int) -> Vocabulary:
    """To the driver: sums by bucket of counts (a sixteenth of a doubling each, some hundreds), and at most `frequent` words.

    The words are all those above a count, the lowest edge of a bucket above which no more than `frequent` words stand. They are
    filtered before they are collected, so tasks send no more than that between them.
    """
    bucket = F.floor(F.log2("c") * 16)
    rows = counts.groupBy(bucket.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.min("c").alias("least")).collect()
    held, least = 0, None
    for r in sorted(rows, key=lambda r: -r["k"]):
        if held + r["v"] > frequent:
            break
        held, least = held + r["v"], r["least"]
    top = counts.where((F.col("c") >= least) | (F.col("word") == "") if held else F.col("word") == "").collect()
    top.sort(key=lambda r: (r["word"] != "", -r["c"], r["word"]))
    words, c = [r["word"].encode() for r in top] or [END], [r["c"] for r in top] or [0]
    return Vocabulary(words, np.array(c, dtype=np.int64), min(own, len(words)), sum(r["n"] for r in rows), sum(r["v"] for r in rows))


def _ending(word: bytes) -> int:
    """The number of a word's last two bytes, or of its only one."""
    return (word[-2] if len(word) > 1 else START) << 8 | word[-1]


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words laid side by side: of each byte the next one and itself (START before each word), and the number of its word;
    only those that the ending doesn't hold."""
    x = np.frombuffer(b" " + b" ".join(words) + b"  ", dtype=np.uint8).astype(np.int64)
    here, after, then = x[:-2], x[1:-1], x[2:]
    number = np.cumsum(here == 32) - 1
    at = np.flatnonzero((after != 32) & (then != 32))
    return after[at], np.where(here[at] == 32, START, here[at]), number[at]


@dataclass(frozen=True)
class Endings:
    """The classes of words that have none of their own, and what is known of the words in them."""

    classes: np.ndarray  # by number of the ending
    pairs: np.ndarray  # log probability of an ending in its class
    before: np.ndarray  # log probability of a byte (START) before another, [next, byte]
    n: np.ndarray  # training tokens by class
    unseen: np.ndarray  # share of new words, by class

    @property
    def count(self) -> int:
        return len(self.n)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return self.classes[[_ending(w) for w in words]] if words else np.zeros(0, dtype=np.int64)

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word among all words of its class that can be written."""
        if not words:
            return np.zeros(0)
        after, byte, number = _joined(words)
        return self.pairs[[_ending(w) for w in words]] + np.bincount(number, weights=self.before[after, byte], minlength=len(words))


def endings(counts: DataFrame, v: Vocabulary, shared: int) -> Endings:
    """Half of the shared classes go to the endings with most tokens, each its own; the others are dealt to the rest by hash.

    To the driver come sums by ending and by pair of bytes, at most 2**17 of each.
    """
    known = set(v.words[: v.own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, _BIGRAMS), dtype=np.int64)
        chained = np.zeros(_BIGRAMS, dtype=np.int64)
        for b in batches:
            rows = [(w.encode(), c) for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True)]
            rows = [(w, c) for w, c in rows if w not in known]
            if not rows:
                continue
            words, c = [w for w, _ in rows], np.array([c for _, c in rows])
            pair = np.array([_ending(w) for w in words])
            for i, weights in enumerate((c, np.ones(len(c)), c == 1)):
                sums[i] += np.bincount(pair, weights=weights, minlength=_BIGRAMS).astype(np.int64)
            after, byte, _ = _joined(words)
            chained += np.bincount(after * (START + 1) + byte, minlength=_BIGRAMS)
        for kind, at, cols in ((0, np.flatnonzero(sums[1]), sums), (1, np.flatnonzero(chained), np.stack([chained] * 3))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), *(pa.array(x[at]) for x in cols)], names=["kind", "at", "n", "types", "once"])

    rows = counts.mapInArrow(run, "kind long, at long, n long, types long, once long").groupBy("kind", "at").agg(*(F.sum(x).alias(x) for x in ("n", "types", "once"))).toPandas()
    pairs, chained = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    n, types, once = (np.zeros((START + 1) << 8) for _ in range(3))
    for into, name in ((n, "n"), (types, "types"), (once, "once")):
        into[pairs["at"]] = pairs[name]
    possible = np.zeros((START + 1) << 8, dtype=bool)
    possible[(np.append(LETTERS, START)[:, None] << 8 | LETTERS[None, :]).ravel()] = True
    own = shared // 2
    classes = np.array([own + zlib.crc32(i.to_bytes(3, "little")) % (shared - own) for i in range(len(n))])
    heavy = np.lexsort((np.arange(len(n)), -n))[:own]
    heavy = heavy[n[heavy] > 0]
    classes[heavy] = np.arange(len(heavy))
    weight = np.where(possible, types + 0.1, 0.0)
    total = np.bincount(classes, weights=weight, minlength=shared)
    with np.errstate(divide="ignore"):
        log_pairs = np.log(weight) - np.log(total[classes])
    table = np.zeros((256, START + 1))
    table.ravel()[chained["at"]] = chained["n"]
    table[:, np.append(LETTERS, START)] += 0.1
    with np.errstate(divide="ignore"):
        before = np.log(table) - np.log(table.sum(axis=1, keepdims=True))
    n, once = (np.bincount(classes, weights=x, minlength=shared) for x in (n, once))
    unseen = np.where(n > 0, np.clip(once / np.maximum(n, 1), 1 / (n + 1), 0.5), 1.0)
    return Endings(classes, log_pairs, before, n, unseen)


def class_counts(v: Vocabulary, e: Endings) -> np.ndarray:
    """Training tokens of each class, one added to each."""
    return np.concatenate([v.counts[: v.own], e.n]).astype(np.float64) + 1


class Numbers(dict):
    """The class of each word; those of endings are looked up, not kept."""

    def __init__(self, v: Vocabulary, e: Endings) -> None:
        super().__init__((w, i) for i, w in enumerate(v.words[: v.own]))
        many = e.classes + v.own
        self.endings = {bytes([i & 255] if i >> 8 == START else [i >> 8, i & 255]): c for i, c in enumerate(many.tolist())}
        for w in v.words[v.own :]:
            self[w] = self.endings[w[-2:]]

    def __missing__(self, word: bytes) -> int:
        return self.endings[word[-2:]]


class Model:
    """Parameters as one flat vector: q and r (classes x width), b (classes), c1 and c2 (width)."""

    def __init__(self, flat: np.ndarray, classes: int, width: int) -> None:
        k, d = classes, width
        self.flat, self.classes, self.width = flat, k, d
        at = np.cumsum([0, k * d, k * d, k, d, d])
        q, r, self.b, self.c1, self.c2 = (flat[a:b] for a, b in zip(at, at[1:], strict=False))
        self.q, self.r = q.reshape(k, d), r.reshape(k, d)

    @staticmethod
    def start(counts: np.ndarray, width: int) -> Model:
        rng = np.random.default_rng(1)
        k = len(counts)
        vectors = rng.normal(0, 0.1, 2 * k * width)
        return Model(np.concatenate([vectors, np.log(counts / counts.sum()), np.ones(2 * width)]).astype(np.float32), k, width)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the last and the last but one class add to each target's score, and the log normaliser of both."""
        r = self.r.T.astype(np.float64)
        one, two = (self.q * self.c1).astype(np.float64) @ r + self.b, (self.q * self.c2).astype(np.float64) @ r
        top1, top2 = one.max(axis=1), two.max(axis=1)
        total = np.exp(one - top1[:, None]) @ np.exp(two - top2[:, None]).T
        z = np.log(total) + top1[:, None] + top2[None, :]
        return one.astype(np.float32), two.astype(np.float32), z.astype(np.float32)


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Adds values to rows; returns the rows touched."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # two bytes are sorted by radix
    own = rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    into[own[first]] += np.add.reduceat(values[order], first, axis=0)
    return own[first]


class Trainer:
    """Noise-contrastive steps with Adagrad on minibatches; the noise words of a batch are shared, so all is matrix products."""

    def __init__(self, model: Model, noise: np.ndarray, samples: int = 64, rate: float = 0.1, seed: int = 0) -> None:
        self.m, self.samples, self.rate = model, samples, rate
        p = noise / noise.sum()
        self.log_noise = np.log(samples * p).astype(np.float32)
        self.edges = np.cumsum(p)
        self.squares = np.full(len(model.flat), 1e-8, dtype=np.float32)
        self.s = Model(self.squares, model.classes, model.width)
        self.rng = np.random.default_rng(seed)

    def _move(self, name: str, grad: np.ndarray, rows: np.ndarray | slice) -> None:
        square, value = getattr(self.s, name), getattr(self.m, name)
        square[rows] += grad**2
        value[rows] -= self.rate * grad / np.sqrt(square[rows])

    def step(self, p1: np.ndarray, p2: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(self.samples)), m.classes - 1)
        q1, q2 = m.q[p1], m.q[p2]
        q = q1 * m.c1 + q2 * m.c2
        rw, rn = m.r[w], m.r[noise]
        real = (q * rw).sum(axis=1) + m.b[w] - self.log_noise[w]
        fake = q @ rn.T + (m.b[noise] - self.log_noise[noise])
        with np.errstate(over="ignore"):  # 1 / inf is as good as 0
            d_real = -1 / (1 + np.exp(real))
            d_fake = np.exp(-fake, out=fake)
        d_fake += 1
        np.reciprocal(d_fake, out=d_fake)
        dq = d_real[:, None] * rw + d_fake @ rn
        size = np.float32(1 / n)
        for name, rows, grad in (
            ("r", np.concatenate([w, noise]), np.concatenate([d_real[:, None] * q, d_fake.T @ q])),
            ("q", np.concatenate([p1, p2]), np.concatenate([dq * m.c1, dq * m.c2])),
            ("b", np.concatenate([w, noise]), np.concatenate([d_real, d_fake.sum(axis=0)])),
        ):
            total = np.zeros(getattr(m, name).shape, dtype=np.float32)
            touched = _scatter(total, rows, grad)
            self._move(name, total[touched] * size, touched)
        self._move("c1", (dq * q1).sum(axis=0) * size, slice(None))
        self._move("c2", (dq * q2).sum(axis=0) * size, slice(None))


def encoded(docs: DataFrame, v: Vocabulary, e: Endings, shards: int) -> DataFrame:
    """(shard, h, ids): each text's class numbers, closed by the end, in two bytes each."""
    schema = T.StructType.fromDDL("shard int, h long, ids binary")
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(v, e).__getitem__
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                ids = [np.array([*map(number, ascii_words(t)), 0], dtype="<u2").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("h"), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(share, F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last and the last but one class before each token, and its own; class 0, the end, stands before a text."""
    x = np.frombuffer(b"".join(b"\0\0\0\0" + t for t in texts), dtype="<u2").astype(np.int64)
    at = targets_of(np.array([len(t) // 2 for t in texts], dtype=np.int64))
    return x[at - 1], x[at - 2], x[at]


def targets_of(lengths: np.ndarray) -> np.ndarray:
    """Positions of the tokens proper where two ends stand before each text."""
    begin = np.cumsum(lengths + 2) - lengths
    return np.arange(lengths.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


def train(docs: DataFrame, v: Vocabulary, e: Endings, width: int = 24, rounds: int = 2, batch: int = 1024, rate: float = 0.1, shard_tokens: int = 2_000_000) -> Model:
    """Averages of the shards' parameters, round by round; a document belongs to one shard of one round, by hash."""
    noise = class_counts(v, e)
    model = Model.start(noise, width)
    if not v.tokens:
        return model
    shards = -(-v.tokens // (rounds * shard_tokens))
    data = cut(encoded(docs, v, e, rounds * shards))
    schema = T.StructType.fromDDL("slice int, part int, n double, x array<float>")

    def run_round(flat: np.ndarray):
        def learned(part: int, rows: Iterator[bytes]) -> pa.RecordBatch:
            own = Model(flat.copy(), len(noise), width)
            trainer, seen, held, size = Trainer(own, noise, rate=rate, seed=part), 0, [], 0

            def learn() -> None:
                p1, p2, w = contexts(held)
                order = trainer.rng.permutation(len(w))
                for at in range(0, len(w), batch):
                    i = order[at : at + batch]
                    trainer.step(p1[i], p2[i], w[i])

            for ids in rows:
                held.append(ids)
                seen, size = seen + len(ids) // 2, size + len(ids) // 2
                if size > 1_000_000:
                    learn()
                    held, size = [], 0
            if held:
                learn()
            x = own.flat.astype(np.float32)
            slices = [x[i : i + SLICE] for i in range(0, len(x), SLICE)]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(len(slices)), pa.int32()), pa.array([part] * len(slices), pa.int32()), pa.array([float(seen)] * len(slices)), pa.array(slices, pa.list_(pa.float32()))],
                names=schema.names,
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True))
            for part, own in itertools.groupby(rows, key=lambda r: r[0]):
                yield learned(part, (ids for _, ids in own))

        return run

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        n = rows["n"].to_numpy()
        x = np.stack([np.asarray(v, dtype=np.float64) for v in rows["x"]])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "part": rows["part"].iloc[:1], "n": [n.sum()], "x": [((n[:, None] * x).sum(axis=0) / n.sum()).astype(np.float32)]})

    for r in range(rounds):
        mine = data.where((F.col("shard") >= r * shards) & (F.col("shard") < (r + 1) * shards))
        # neighbouring shards may share a task, which runs over them one after the other
        mine = mine.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        parts = mine.mapInArrow(run_round(model.flat), schema)
        # two steps, so that no task gathers the parameters of all
        some = parts.groupBy("slice", F.pmod("part", F.lit(64)).alias("salt")).applyInPandas(mean, schema)
        rows = some.groupBy("slice").applyInPandas(mean, schema).select("slice", "x").collect()
        if rows:
            model = Model(np.concatenate([np.array(x["x"], dtype=np.float32) for x in sorted(rows, key=lambda x: x["slice"])]), len(noise), width)
    return model


_tables: dict[int, tuple] = {}


def _tables_of(flat: np.ndarray, classes: int, width: int) -> tuple:
    """One computation per worker process and model."""
    key = zlib.crc32(flat.tobytes())
    if key not in _tables:
        _tables.clear()
        _tables[key] = Model(flat, classes, width).tables()
    return _tables[key]


def inner_scores(v: Vocabulary, e: Endings) -> np.ndarray:
    """log10 probability of each frequent word in its class."""
    out = np.zeros(len(v.words))
    tail = v.words[v.own :]
    if tail:
        k = e.numbers(tail)
        out[v.own :] = np.log10((1 - e.unseen[k]) * v.counts[v.own :] / np.maximum(e.n[k], 1) + e.unseen[k] * np.exp(e.spelled(tail)))
    return out


def score_parts(docs: DataFrame, v: Vocabulary, e: Endings, model: Model) -> DataFrame:
    """A row per document with what its frequent words give, and a row per distinct other word with how often it stands.

    Columns: doc_id, h (hash of the text), held_out, n_tokens, n_known, base_score, score, word, times, seen (probability in its class for
    each time it is counted), spelled (probability added by its spelling). n_tokens is null in the rows of words; word is, in the rows of
    documents, a text that is no word and differs between them.
    """
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("h long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word string, times long, seen double, spelled double").fields])
    types = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema]
    denominator = np.log10(v.tokens + v.distinct + 1.0)
    base = np.append(np.log10(v.counts + 1.0) - denominator, 0.0)
    inner = np.append(inner_scores(v, e), 0.0)
    flat, classes, width = model.flat, model.classes, model.width
    each, new = (1 - e.unseen) / np.maximum(e.n, 1), e.unseen
    doubts = v.counts[0] == 0  # no text ends among those learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, z = _tables_of(flat, classes, width)
        ids, kinds = {w: i for i, w in enumerate(v.words)}, np.append(np.arange(v.own), e.numbers(v.words[v.own :]) + v.own)
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                words = [ascii_words(t) for t in part.column("text").to_pylist()]
                lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
                i = np.array([x for own in words for x in (*(ids.get(w, -1) for w in own), 0)], dtype=np.int64)
                begin = np.cumsum(lengths) - lengths
                c = np.where(i >= 0, kinds[i], 0)
                at = np.flatnonzero(i < 0)
                owner = np.searchsorted(begin, at, side="right") - 1
                loose = [words[k][x] for k, x in zip(owner.tolist(), (at - begin[owner]).tolist(), strict=True)]
                c[at] = e.numbers(loose) + v.own
                p1 = np.concatenate([[0], c[:-1]])
                p2 = np.concatenate([[0, 0], c[:-2]])[: len(c)]
                p1[begin], p2[begin] = 0, 0
                second = begin[lengths > 1] + 1
                p2[second] = 0
                logp = (one[p1, c].astype(np.float64) + two[p2, c] - z[p1, p2]) / np.log(10)
                scores = np.add.reduceat(logp + inner[i], begin)
                bases = np.add.reduceat(base[i], begin)
                known = np.add.reduceat((i >= 0).astype(np.int64), begin) - int(doubts)
                n, marks = part.num_rows, [f" {h} {low + k}" for k, h in enumerate(part.column("h").to_pylist())]
                made = [lengths, known, bases, scores, pa.array(marks), np.ones(n, np.int64), np.zeros(n), np.zeros(n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), part.column("held_out"), *map(pa.array, made)], names=schema.names)
                # (document, word) to how often it stands there
                others = Counter(zip(owner.tolist(), loose, strict=True))
                if others:
                    source, names = zip(*others, strict=True)
                    kind = e.numbers(list(names))
                    spelled = new[kind] * np.exp(e.spelled(list(names)))
                    source, none = pa.array(source), [pa.nulls(len(names), f.type) for f in types[2:7]]
                    made = [pa.array([w.decode() for w in names]), pa.array(list(others.values()), pa.int64()), pa.array(each[kind]), pa.array(spelled)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(source), part.column("h").take(source), *none, *made], names=schema.names)

    return docs.select("doc_id", "h", "held_out", "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, own: int = 1536, shared: int = 512, frequent: int = 100_000, **training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Frequent words are looked up in a dictionary of bounded size; the others are joined to their counts.
    """
    docs = docs.select("doc_id", "text").withColumns(
        {"h": F.xxhash64("text"), "held_out": F.coalesce(crc32_mod("doc_id", folds) == fold, F.lit(False))}
    )
    learned = docs.where(~F.col("held_out"))
    counts = cut(count_words(learned))
    v = vocabulary(counts, own, frequent)
    e = endings(counts, v, shared)
    model = train(learned, v, e, **training)
    every = v.tokens + v.distinct + 1.0
    times, c, is_word = F.col("times"), F.coalesce("c", F.lit(0)), F.col("n_tokens").isNull()
    # spelling alone may give a long word less than the least double
    inside = F.log10(F.greatest(F.col("seen") * c + F.col("spelled"), F.lit(1e-300)))
    parts = score_parts(docs, v, e, model).join(counts, "word", "left").select(
        "doc_id", "h", "held_out", "n_tokens",
        F.when(is_word, F.when(c > 0, times).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(is_word, times * F.log10((c + 1) / F.lit(every))).otherwise(F.col("base_score")).alias("base_score"),
        F.when(is_word, times * inside).otherwise(F.col("score")).alias("score"),
    )
    # rows repeated in full have one sum; each is given its part again
    sums = parts.groupBy("doc_id", "h").agg(
        F.max("held_out").alias("held_out"), F.count("n_tokens").alias("rows"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return sums.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
