"""Toxicity: a logistic classifier that is trained to ignore which group a sentence is about.

A text's score is a logistic function of the sum of its distinct words' values; a word's value is the sum of the weights of its hashed
features: the word itself and its runs of four and five bytes. The features whose counts differ most between the labels are fitted, and
those of all identity terms.

Counterfactuals: in each sentence of a labelled text that holds an identity term, each term in turn is swapped for the next one of its
kind, and the loss adds the square of the change in score. Each term also stands in made neutral sentences, which are
clean rows and have their swaps, so that terms the labelled texts don't hold are held, too. false_alarms() tells how often a
neutral sentence about each term is taken for toxic.

Training rows: labelled, not held out, one per id, and of these at most `most_rows` of each label, by the hash of their id: that is the
documented bound of the fit. A row weighs as many as it stands for (rows of its label by rows sampled), so the fit is one at the
labels' true shares whatever the size of the table. Rows stay on the executors: each step of the fit (L-BFGS) sums the gradient over them
there. Scoring covers all rows and whole texts.

Defined results: a null or empty text gets the score of no features; labels that are null or not 0 or 1 aren't learned from, and an id
labelled both ways counts as toxic; an id that stands on several documents is learned from once, by the least text;
without labels of both kinds every score is that of the one label there is (0 if none); a null id is scored and not held out; repeated rows are
scored each; a very long text is read whole; an empty table gives an empty result; columns kept may have any names, but two of one name can't be told apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, cut, map_texts

#: Identity terms by kind; a counterfactual takes the next one of the row.
IDENTITIES = [
    "women men".split(),
    "woman man".split(),
    "girls boys".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "gay straight lesbian bisexual".split(),
    "transgender cisgender".split(),
    "black white asian latino".split(),
    "african european american chinese mexican indian arab russian".split(),
    "immigrants natives refugees citizens".split(),
    "old young".split(),
    "disabled blind deaf".split(),
]
KIND = {w.encode(): [x.encode() for x in row] for row in IDENTITIES for w in row}
SWAP = {w.encode(): row[(i + 1) % len(row)].encode() for row in IDENTITIES for i, w in enumerate(row)}

#: Neutral sentences; each identity term stands in each.
NEUTRAL = ["i am {}", "many {} people live in this city", "she works with {} friends", "the {} family came to the school today"]

BITS = 20
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SENTENCE = re.compile(r"[.!?\n]+")
REMEMBERED = 400_000
#: Words whose features are found at once.
CHUNK = 50_000


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a whole text: runs of ASCII digits, letters and bytes beyond, A-Z lower-cased."""
    return set(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) if text else set()


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature), words in order: hashes of each word itself and of its runs of four and five bytes, ends marked."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = np.frombuffer(b"".join([b"^%b$" % w for w in words]), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(size) - size
    number, place = np.repeat(np.arange(len(words)), size), np.arange(len(x)) - np.repeat(begin, size)
    left = size[number] - place
    powers = np.cumprod(np.full(max(size.max(), 5), _FACTOR))
    owners, hashes = [np.arange(len(words))], [np.add.reduceat(x * powers[place], begin)]
    for n in (4, 5):
        at = np.flatnonzero(left >= n)
        owners.append(number[at])
        hashes.append(sum(x[at + j] * powers[j] for j in range(n)) + powers[:1] * np.uint64(n << 8))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
    order = np.argsort(owner, kind="stable")
    return owner[order], h[order].astype(np.int64)


def swaps(text: str | None) -> Iterator[tuple[bytes, bytes]]:
    """(term, counterpart) of each swap in each sentence; the counterpart is empty where the sentence holds it already."""
    for sentence in _SENTENCE.split(text or ""):
        words = words_of(sentence)
        for w in words & SWAP.keys():
            yield w, SWAP[w] if SWAP[w] not in words else b""


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature, and what a text without features scores before the logistic function."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _training_rows(docs: DataFrame, labels: DataFrame, folds: int, most_rows: int) -> tuple[DataFrame, list[float]]:
    """(doc_id, toxic) of the rows to learn from, and how many rows of each label one of them stands for."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(crc32_mod("doc_id", folds) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for y in (0, 1):
        # a share by hash first, so that hardly more than the bound is sorted
        share = min(1.0, 1.2 * most_rows / max(1, n.get(y, 0)) + 0.001)
        mine = known.where((F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
        parts.append(mine.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), "doc_id").limit(most_rows))
    ids = cut(parts[0].union(parts[1]))
    sampled = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    return ids, [n.get(y, 0) / sampled[y] if y in sampled else 1.0 for y in (0, 1)]


def _counted(texts: DataFrame) -> DataFrame:
    """(kind, a, b, toxic, clean): by feature (kind 0), by swap of two terms (1), and rows by label (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, terms, held = [0, 0], [Counter(), Counter()], [Counter(), Counter()]

        def flush() -> Iterator[pa.RecordBatch]:
            seen = np.zeros((2, 1 << BITS), dtype=np.int64)
            for y in (0, 1):
                words, times = list(held[y]), np.array(list(held[y].values()), dtype=np.int64)
                for low in range(0, len(words), CHUNK):
                    word, feature = features_of(words[low : low + CHUNK])
                    seen[y] += np.bincount(feature, weights=times[low + word], minlength=1 << BITS).astype(np.int64)
                held[y].clear()
            f = np.flatnonzero(seen.any(axis=0))
            none = pa.array([None] * len(f), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(f), np.int64)), pa.array(f), none, none, pa.array(seen[1][f]), pa.array(seen[0][f])], names=names)

        names = ["kind", "feature", "a", "b", "toxic", "clean"]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                rows[y] += 1
                held[y].update(words_of(text))
                terms[y].update(swaps(text))
                if len(held[0]) + len(held[1]) > REMEMBERED:
                    yield from flush()
        yield from flush()
        both = sorted(terms[0].keys() | terms[1].keys())
        out = [(1, None, a.decode(), b.decode(), terms[1][a, b], terms[0][a, b]) for a, b in both] + [(2, None, None, None, rows[1], rows[0])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)

    counts = texts.select("text", "toxic").mapInArrow(run, "kind long, feature long, a string, b string, toxic long, clean long")
    return counts.groupBy("kind", "feature", "a", "b").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 20_000, most_features: int = 20_000, penalty: float = 1.0, neutral: float = 0.02) -> Model:
    """Fits the classifier. To the driver come most_features numbers, sums of swaps by pair of terms, and a gradient a step.

    penalty weighs the mean squared change under swaps; neutral is what all made sentences weigh against the labelled rows, beside what
    toxic sentences about their kind weigh, and 0 leaves them out.
    """
    ids, stands_for = _training_rows(docs, labels, folds, most_rows)
    # at most 2 * most_rows ids of 12 bytes; of documents that share an id one is learned from
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(F.broadcast(ids), "doc_id")
    texts = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    counts = cut(_counted(texts))
    totals = counts.where("kind = 2").first()
    n1, n0 = (totals["toxic"] * stands_for[1], totals["clean"] * stands_for[0]) if totals else (0, 0)
    if not n1 or not n0:
        return Model(np.array([], dtype=np.int64), np.array([]), 30.0 if n1 else -30.0)
    # rates by row of each label, and how far apart they are for what their counts vary
    a, b = F.col("toxic") / totals["toxic"], F.col("clean") / totals["clean"]
    apart = (a - b) * (a - b) / (a / totals["toxic"] + b / totals["clean"])
    best = counts.where("kind = 0 and toxic + clean >= 3").orderBy(apart.desc(), "feature").limit(most_features)
    chosen = {r["feature"] for r in best.select("feature").collect()} | set(features_of(list(SWAP))[1].tolist())
    chosen = np.array(sorted(chosen), dtype=np.int64)

    def of_words(words: list[bytes]) -> list[np.ndarray]:
        """The numbers of each word's chosen features."""
        word, feature = features_of(words)
        at = np.searchsorted(chosen, feature)
        mine = chosen[np.minimum(at, len(chosen) - 1)] == feature
        return np.split(at[mine].astype("<i4"), np.cumsum(np.bincount(word[mine], minlength=len(words)))[:-1]) if words else []

    together = lambda words: np.concatenate([np.zeros(0, dtype="<i4"), *of_words(sorted(words))])
    changes, blamed = Counter(), Counter()
    for r in counts.where("kind = 1").collect():
        changes[r["a"].encode(), r["b"].encode()] += r["toxic"] * stands_for[1] + r["clean"] * stands_for[0]
        for w in KIND[r["a"].encode()]:
            blamed[w] += r["toxic"] * stands_for[1]
    made = [(w, s.format(w.decode())) for w in SWAP for s in NEUTRAL] if neutral else []
    # toxic sentences about a kind weigh as much as neutral ones about each term of it
    weigh = [neutral * (n1 + n0) / len(made) + blamed[w] / len(NEUTRAL) for w, _ in made]
    for (_, text), share in zip(made, weigh, strict=True):
        for pair in swaps(text):
            changes[pair] += share

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                own = [together(words_of(t)).tobytes() for t in part.column("text").to_pylist()]
                weight = [stands_for[y] for y in part.column("toxic").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), part.column("toxic").cast(pa.int64()), pa.array(weight, pa.float64())], names=["own", "y", "weight"])

    # a few parts whatever the table's: at most 2 * most_rows rows are dealt over them
    data = cut(texts.select("text", "toxic").mapInArrow(packed, "own binary, y long, weight double").repartition(8))
    extra = _block([together(words_of(t)) for _, t in made], np.zeros(len(made)), np.array(weigh), len(chosen))
    pairs = [(np.concatenate([together([x]), -1 - together([y] if y else [])]).astype(np.int64), n) for (x, y), n in sorted(changes.items())]
    weights, bias = fit(lambda w: _sums(data, w), extra, pairs, n1, n0, len(chosen), penalty)
    return Model(chosen, weights, bias)


def _block(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, k: int) -> tuple:
    """Features of rows laid side by side, each row ended by feature k, the bias; where rows begin, their lengths, y and weights."""
    lengths = np.array([len(r) + 1 for r in rows], dtype=np.int64)
    end = np.array([k], dtype=np.int32)
    col = np.concatenate([x for r in rows for x in (r, end)]) if rows else np.zeros(0, dtype=np.int32)
    return col, np.cumsum(lengths) - lengths, lengths, y, weight


def _loss(block: tuple, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted logistic loss of a block and its gradient."""
    col, begin, lengths, y, weight = block
    if not len(lengths):
        return 0.0, np.zeros(len(w))
    z = np.add.reduceat(w[col], begin)
    error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
    loss = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()
    return float(loss), np.bincount(col, weights=np.repeat(error, lengths), minlength=len(w))


def _sums(data: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss and gradient over rows (own, y, weight), summed part by part on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros(len(w))
        for b in batches:
            for low in range(0, b.num_rows, 2000):
                part = b.slice(low, 2000)
                rows = [np.frombuffer(x, dtype="<i4") for x in part.column("own").to_pylist()]
                more, g = _loss(_block(rows, part.column("y").to_numpy(), part.column("weight").to_numpy(), len(w) - 1), w)
                loss, gradient = loss + more, gradient + g
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()])], names=["loss", "gradient"])

    parts = data.mapInArrow(run, "loss double, gradient binary").collect()
    return sum(r["loss"] for r in parts), np.sum([np.frombuffer(r["gradient"]) for r in parts], axis=0)


def fit(sums: Callable, extra: tuple, pairs: list, n1: float, n0: float, k: int, penalty: float, ridge: float = 5e-4, rounds: int = 45) -> tuple[np.ndarray, float]:
    """Weights and bias of the least mean logistic loss, ridge, and penalty times the mean squared change in score under swaps.

    sums: weights to loss and gradient over the labelled rows. pairs: (features gained, and lost as -1 - f; times).
    """
    n, swapped = n1 + n0, sum(c for _, c in pairs)
    rows = n + extra[4].sum()
    sides = [(np.where(f < 0, -1 - f, f), np.where(f < 0, -1.0, 1.0), c / swapped) for f, c in pairs]

    def target(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = sums(w)
        more, h = _loss(extra, w)
        loss, g = (loss + more) / rows + ridge / 2 * (w[:-1] @ w[:-1]), (g + h) / rows
        g[:-1] += ridge * w[:-1]
        for at, sign, c in sides:
            change = (w[at] * sign).sum()
            loss += penalty * c * change**2
            np.add.at(g, at, 2 * penalty * c * change * sign)
        return loss, g

    w = np.zeros(k + 1)
    w[-1] = np.log(n1 / n0)
    return (lambda x: (x[:-1], float(x[-1])))(least(target, w, rounds))


def least(target: Callable, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with steps halved until the value falls enough; ends where no step helps or after some evaluations."""
    value, g = target(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    left = rounds
    while left > 0 and np.abs(g).max() > 1e-7:
        d, coefficients = -g, []
        for s, y in reversed(past):
            coefficients.append((s @ d) / (s @ y))
            d = d - coefficients[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(coefficients), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        while left > 0:
            left -= 1
            new, h = target(x + step * d)
            if new <= value + 1e-4 * step * (g @ d):
                break
            step /= 4
        else:
            break
        s, y = step * d, h - g
        x, value, g = x + s, new, h
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
    return x


def scorer(model: Model):
    """A function from a list of texts to their scores, with a memory of words of its own in each task."""
    features, weights, bias = model.features, model.weights, model.bias
    values: dict[bytes, float] = {}
    table = np.zeros(0)

    def learn(words: list[bytes]) -> None:
        nonlocal table
        if not len(table):
            table = np.zeros(1 << BITS)
            table[features] = weights
        for low in range(0, len(words), CHUNK):
            part = words[low : low + CHUNK]
            word, feature = features_of(part)
            values.update(zip(part, np.bincount(word, weights=table[feature], minlength=len(part)).tolist(), strict=True))

    def score(texts: list) -> list[float]:
        out = []
        for low in range(0, len(texts), 200):
            own = [words_of(t) for t in texts[low : low + 200]]
            learn(list(set().union(*own).difference(values)))
            out += [bias + math.fsum(map(values.__getitem__, words)) for words in own]
            if len(values) > REMEMBERED:
                values.clear()
        return [float(x) for x in 1 / (1 + np.exp(-np.clip(np.array(out), -500, 500)))]

    return score


def false_alarms(model: Model) -> dict[str, float]:
    """For each identity term, the share of neutral sentences about it that the model takes for toxic."""
    score = scorer(model)
    return {w.decode(): sum(x >= 0.5 for x in score([s.format(w.decode()) for s in NEUTRAL])) / len(NEUTRAL) for w in SWAP}


def score_documents(docs: DataFrame, model: Model, keep: list[str], folds: int = 5) -> DataFrame:
    """The columns kept, held_out, score and predicted of every row. One pass, no shuffle; a column kept may have one of these names."""
    score = scorer(model)

    def run(texts: list) -> list:
        scores = score(texts)
        return [scores, [int(s >= 0.5) for s in scores]]

    held = F.coalesce(crc32_mod("doc_id", folds) == 0, F.lit(False)).alias("held")
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    marked = map_texts(docs.select(*kept, held, "text"), [*(f"c{i}" for i in range(len(keep))), "held"], "score double, predicted int", run)
    return marked.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("held").alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; columns and whole texts unchanged."""
    score = scorer(train(docs, labels))
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes
    renamed = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    marked = map_texts(renamed, list(names.values()), "score double", lambda texts: [score(texts)])
    return marked.where("score < 0.5").select(*(F.col(n).alias(c) for c, n in names.items()))
