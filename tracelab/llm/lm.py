"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

Counts of all training tokens come from one pass.  The model predicts a class
from the two classes before: the class's score is the inner product of its
vector with the sum of the two context vectors, each weighed by position, plus
a bias.  The most frequent words and the end are classes of their own; other
frequent words share classes of about equal shares of the tokens, by rank; all
further words, unseen ones included, are dealt to classes by hash.  A word's
probability is its class's times its share of the class's tokens, so each word
is scored by a class with vectors, and both levels sum to one.  The number of
classes grows with the root of the distinct words up to ``MOST_CLASSES``.

Texts are encoded once, for training and scoring: the class ids of each, and
its words that are not among the known ones.  Every task trains a copy in numpy
on its part of the training texts (every position of all of them) and the copies are averaged, weighed by positions;
the next of ``ROUNDS`` rounds over all texts starts from the average.

Scores are additive in the two context classes, so the normaliser of all pairs
of context classes is one matrix product of exponentials; with it a class's
normalised log probability is three table look-ups.

Counts of the most frequent words are broadcast (at most ``FREQUENT`` words of
at most ``FREQUENT_BYTES`` bytes); the occurrences of the others are joined
with the table of counts by word.

Defined cases: a null or empty text is its end token; without training texts
N and V are 0, words have the smoothed count of an unseen one, and the model
has the end and classes of unseen words; a null doc_id hashes as an empty text (training);
repeated rows are counted and scored each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelab.llm.common import stash, text_bytes

#: Folds: a text is held out if crc32 of its doc_id leaves HELD_OUT (fixed values).
FOLDS, HELD_OUT = 5, 1
LEAST_CLASSES, MOST_CLASSES = 64, 2048  # the normaliser is a table of their square (ids fit 16 bits)
CLASSES_BY_ROOT = 4  # classes for each unit of the root of the distinct words
DIMENSIONS = 24
ROUNDS = 3
TEXTS_AT_ONCE = 256
BATCH, NOISE, RATE = 2048, 64, 0.2
FREQUENT, FREQUENT_BYTES = 100_000, 64
LEVELS, SHARES = 16, 4096
END = 0
IDS = np.dtype("<u2")  # class ids in a column: a block of bytes a text costs Spark less than an array
COUNTER_WORDS = 200_000
ENCODED_BYTES = 1 << 22  # of texts that are encoded at once
COPY_POSITIONS = 1 << 23  # about so many train a copy at least, where there are more copies than cores
ROW = 16  # parameters in a row when copies are added up


def fold(docs: DataFrame) -> DataFrame:
    """(doc_id, t, held_out)."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"), (rest == HELD_OUT).alias("held_out"))


def _words(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    for x in batch.column(column):
        yield x.as_buffer().to_pybytes().lower().split()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all these texts (as ``_words`` has them), and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())))
    words, lengths = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    empty = pc.binary_length(words).to_numpy() == 0  # left by white space at the ends
    if empty.any():
        lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[empty], minlength=len(lengths))
        words = words.filter(pa.array(~empty))
    return words.view(texts.type), lengths


def word_counts(training: DataFrame) -> DataFrame:
    """``training`` (t) -> (w binary, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "c"])
        for b in batches:
            for words in _words(b, 0):
                seen.update(words)
                if len(seen) > COUNTER_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    return training.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, frequent: int) -> list:
    """At most ``frequent`` of the most frequent words (w, c), by count.

    A histogram of the counts (LEVELS buckets an octave) gives the buckets that
    fit whole; the next one is filled by hash of the word.  The driver gets the
    two histograms and the chosen words, however many partitions there are."""
    short = counts.where(F.length("w") <= FREQUENT_BYTES)
    level = F.floor(F.log2("c") * LEVELS).cast("int")
    left, edge, cut = frequent, -1, 0
    for r in sorted(short.groupBy(level.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):
        if r.n > left:
            edge = r.b
            break
        left -= r.n
    share = F.pmod(F.xxhash64("w"), F.lit(SHARES))
    if edge >= 0:
        for r in sorted(short.where(level == edge).groupBy(share.alias("h")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.h):
            if r.n > left:
                break
            left, cut = left - r.n, r.h + 1
    chosen = short.where((level > edge) | ((level == edge) & (share < cut)))
    return sorted(chosen.collect(), key=lambda r: (-r.c, bytes(r.w)))


@dataclass
class Classes:
    """The class of every word: ``of`` by rank among the known words, and for
    others one of ``hashed`` classes from ``first_hashed`` on."""

    known: dict[bytes, int]
    of: np.ndarray
    first_hashed: int
    hashed: int

    @property
    def size(self) -> int:
        return self.first_hashed + self.hashed

    @classmethod
    def deal(cls, words: list[bytes], counts: np.ndarray, others: float, wanted: int) -> Classes:
        """Half of the classes to single words by falling count; the rest to the
        known words left and to the ``others`` (a number of tokens) by their shares."""
        own = min(len(words), max(0, wanted // 2 - 1))
        left = counts[own:]
        spare = max(1, wanted - 1 - own)
        binned = min(len(left), max(1, round(spare * left.sum() / (left.sum() + others)))) if len(left) and spare > 1 else 0
        if len(left) and not binned:  # no room: they are hashed like the others
            words, left = words[:own], left[:0]
        binned = min(binned, max(0, spare - 1))
        before = np.cumsum(left) - left
        bins = np.minimum((before * (binned / max(left.sum(), 1))).astype(np.int64), max(binned - 1, 0))
        _, bins = np.unique(bins, return_inverse=True)
        used = int(bins.max()) + 1 if len(bins) else 0
        of = np.concatenate([1 + np.arange(own), 1 + own + bins]).astype(np.int64)
        return cls({w: i for i, w in enumerate(words)}, of, 1 + own + used, max(1, spare - used))

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The rank (-1: not known) and the class of each word."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        of = self.of[at] if len(self.of) else np.zeros(len(at), np.int64)
        rest = np.flatnonzero(at < 0)
        of[rest] = [self.first_hashed + crc32(words[i]) % self.hashed for i in rest.tolist()]
        return at, of

    def found(self, words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """``places`` of the words, with the known words in an array; and for those
        not known: where they are, and the number of each among the distinct ones."""
        at = pc.index_in(words, value_set=known.cast(words.type)).fill_null(-1).to_numpy().astype(np.int64)
        of = self.of[at] if len(self.of) else np.zeros(len(at), np.int64)
        missing = np.flatnonzero(at < 0)
        rest = words.take(pa.array(missing)).dictionary_encode()
        which, distinct = rest.indices.to_numpy().astype(np.int64), rest.dictionary
        of[missing] = np.array([self.first_hashed + crc32(w) % self.hashed for w in distinct.to_pylist()], np.int64)[which]
        return at, of, missing, which, distinct


@dataclass
class Model:
    """Vectors by class (context and predicted), position weights, biases."""

    context: np.ndarray
    word: np.ndarray
    position: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 1) -> Model:
        """Small random vectors; biases that give the classes their shares."""
        rng = np.random.default_rng(seed)
        n = len(share)
        parts = rng.normal(0, 0.1, (n, dimensions)), rng.normal(0, 0.1, (n, dimensions)), np.ones((2, dimensions)), np.log(share)
        return cls(*(x.astype(np.float32) for x in parts))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.word, self.position, self.bias)])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.context, self.word, self.position, self.bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)


def _summed(at: np.ndarray, values: np.ndarray, n: int, cells: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``values`` (doubles) of each of ``n`` places, counted
    in one go: ``cells`` numbers the cells of the sum, ``room`` is for theirs."""
    cells.take(at, axis=0, out=room, mode="clip")  # "raise" would make an array first
    return np.bincount(room.ravel(), values.ravel(), n * values.shape[1]).astype(np.float32).reshape(n, -1)


def _places(n: int, *ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of the ids below ``n``, and the place of each among them."""
    seen = np.zeros(n, bool)
    for x in ids:
        seen[x] = True
    return np.flatnonzero(seen), np.cumsum(seen) - 1


def _sigmoid(minus: np.ndarray) -> np.ndarray:
    """In place, and of the numbers with their signs changed."""
    np.minimum(minus, 30, out=minus)
    np.exp(minus, out=minus)
    minus += 1
    return np.reciprocal(minus, out=minus)


class Trainer:
    """Adagrad steps of noise-contrastive estimation on batches of (two before, next)."""

    def __init__(self, model: Model, share: np.ndarray, seed: int | list[int], sums: Model | None = None):
        self.model, self.positions = model, 0
        self.rng = np.random.default_rng(seed)
        self.cum = np.cumsum(share)
        self.base = np.log(NOISE * share).astype(np.float32)
        self.sums = sums or model.filled(np.full(model.flat().size, 1e-8))
        self.cells = np.arange(model.word.size).reshape(model.word.shape)
        self.room: tuple[np.ndarray, ...] = ()
        self.noise_room = np.empty((NOISE, model.word.shape[1]), np.intp)

    def rooms(self, n: int) -> tuple[np.ndarray, ...]:
        """Room for the arrays of a batch, kept from step to step: arrays of this
        size made anew are given back to the system and zeroed at every step."""
        if not self.room or self.room[0].shape[1] != n:
            width = self.model.context.shape[1]
            self.room = np.empty((6, n, width), np.float32), np.empty((n, NOISE), np.float32), np.empty((n, width), np.intp), np.empty((n, width))
        return self.room

    def step(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> None:
        m, n, size = self.model, len(w), len(self.base)
        (r1, r2, guess, word, toward, part), wrong, room, values = self.rooms(n)
        h1, h2, w = (x.astype(np.intp) for x in (h1, h2, w))
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), size - 1)
        for x, ids, out in (m.context, h1, r1), (m.context, h2, r2), (m.word, w, word):
            x.take(ids, axis=0, out=out, mode="clip")
        np.multiply(r1, m.position[0], out=guess)
        guess += np.multiply(r2, m.position[1], out=part)
        other, bias = m.word.take(noise, axis=0), m.bias - self.base
        right = np.einsum("ij,ij->i", guess, word) + bias.take(w)
        right = (1 - _sigmoid(-right)) / n  # towards the data
        np.matmul(guess, -other.T, out=wrong)
        wrong -= bias.take(noise)
        _sigmoid(wrong)
        wrong /= np.float32(n)  # away from the noise
        np.multiply(right[:, None], word, out=toward)
        toward -= np.matmul(wrong, other, out=part)
        # Only classes with a gradient are summed and moved; the others stay as they are.
        context, place = _places(size, h1, h2)
        values[...] = toward
        first, second = (_summed(place.take(x), values, len(context), self.cells, room) for x in (h1, h2))
        contexts = first * m.position[0] + second * m.position[1]
        both = np.stack([np.einsum("ij,ij->j", toward, r) for r in (r1, r2)])
        words, place = _places(size, w, noise)
        at, drawn, k = place.take(w), place.take(noise), len(words)
        values[...] = np.multiply(right[:, None], guess, out=part)
        vectors = _summed(at, values, k, self.cells, room)
        vectors -= _summed(drawn, (wrong.T @ guess).astype(np.float64), k, self.cells, self.noise_room)
        biases = np.bincount(at, right, k).astype(np.float32) - np.bincount(drawn, wrong.sum(0), k).astype(np.float32)
        sums = self.sums
        moves = (m.context, sums.context, contexts, context), (m.word, sums.word, vectors, words), (m.position, sums.position, both, np.arange(2)), (m.bias, sums.bias, biases, words)
        for x, s, g, at in moves:
            of = g * g
            of += s.take(at, axis=0)
            s[at] = of
            g *= np.float32(RATE)
            g /= np.sqrt(of, out=of)
            g += x.take(at, axis=0)
            x[at] = g
        self.positions += n


def encoded(docs: DataFrame, classes: Classes, weights: tuple[np.ndarray, ...] = ()) -> DataFrame:
    """``docs`` (t, other columns) -> the other columns, and for every text
    ``uid``, ``ids`` (two ends, the classes of its words, and the end, as IDS),
    ``n_found`` (its known words), ``sums`` (of each of ``weights``, by rank, over
    these) and ``rare`` (w, k): its words that are not known, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, weights))
    others = [f for f in docs.schema.fields if f.name != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights = shared.value
        known = pa.array(list(classes.known), pa.binary())
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            column = whole.schema.get_field_index("t")
            part = np.cumsum(pc.binary_length(whole.column(column)).to_numpy()) // ENCODED_BYTES
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for at, end in zip(starts, [*starts[1:], whole.num_rows], strict=True):
                b = whole.slice(at, end - at)
                words, lengths = _split(b.column(column))
                text = np.repeat(np.arange(b.num_rows), lengths)
                at, of, missing, which, distinct = classes.found(words, known)
                ids = np.full(len(at) + 3 * b.num_rows, END, IDS)
                ids[np.arange(len(at)) + 3 * text + 2] = of
                ends = np.cumsum(lengths + 3) * IDS.itemsize
                found = np.bincount(text[at >= 0], minlength=b.num_rows)
                at, bounds = at[at >= 0], [0, *np.cumsum(found).tolist()]
                sums = [[x[at[i:j]].sum() for x in weights] for i, j in zip(bounds, bounds[1:], strict=False)]
                pair, k = np.unique(text[missing] * len(distinct) + which, return_counts=True)
                pairs = pa.StructArray.from_arrays([distinct.take(pa.array(pair % len(distinct))).cast(pa.binary()), pa.array(k, pa.int64())], names=["w", "k"])
                rare = np.cumsum(np.bincount(pair // len(distinct), minlength=b.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(f.name)) for f in others), pa.array(uid + np.arange(b.num_rows)),
                     pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(ids)]),
                     pa.array(found, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(np.r_[0, rare], pa.int32()), pairs)],
                    names=[*(f.name for f in others), "uid", "ids", "n_found", "sums", "rare"],
                )
                uid += b.num_rows

    schema = StructType(others + StructType.fromDDL("uid long, ids binary, n_found long, sums array<double>, rare array<struct<w:binary,k:long>>").fields)
    return docs.mapInArrow(run, schema)


def _ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The class ids of all these texts, and how many each has."""
    texts = texts.to_pylist()
    return np.frombuffer(b"".join(texts), IDS), np.fromiter(map(len, texts), np.int64, len(texts)) // IDS.itemsize


def train(training: DataFrame, classes: Classes, share: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, int]:
    """In each round the average (of parameters and of Adagrad's sums) of the
    copies trained by each task over its texts, and the positions trained on in
    a round.  ``training`` has texts (t), or what ``encoded`` made of them."""
    spark = training.sparkSession
    texts = (training if "ids" in training.columns else stash(encoded(training, classes), "lm-texts")).select("ids")
    model = Model.start(share)
    sums = model.filled(np.full(model.flat().size, 1e-8))
    positions, columns = 0, [f"x{i}" for i in range(ROW)]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((share, model, sums))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            share, model, sums = shared.value
            t = Trainer(model.filled(model.flat()), share, [turn, TaskContext.get().partitionId()], sums.filled(sums.flat()))
            held, size = [], 0
            for b in batches:
                for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                    ids, lengths = _ids(b.column(0).slice(i, TEXTS_AT_ONCE))
                    target = np.ones(len(ids), bool)
                    starts = np.cumsum(lengths) - lengths
                    target[starts] = target[starts + 1] = False  # the two ends in front
                    at = np.flatnonzero(target)
                    held.append(np.stack([ids[at - 1], ids[at - 2], ids[at]]))
                    size += len(at)
                    if size >= BATCH:
                        every = np.concatenate(held, axis=1)
                        for j in range(0, size - size % BATCH, BATCH):
                            t.step(*every[:, j : j + BATCH])
                        held, size = [every[:, size - size % BATCH :]], size % BATCH
            if size:
                t.step(*np.concatenate(held, axis=1))
            if t.positions:
                flat = np.r_[float(t.positions), np.r_[t.model.flat(), t.sums.flat()].astype(np.float64) * t.positions]
                rows = np.r_[flat, np.zeros(-len(flat) % len(columns))].reshape(-1, len(columns))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), *(pa.array(x) for x in rows.T.copy())], names=["i", *columns])

        copies = texts.mapInArrow(run, ", ".join(["i int", *(f"{x} double" for x in columns)]))
        parts = copies.groupBy("i").agg(*(F.sum(x).alias(x) for x in columns)).toPandas().sort_values("i")
        if not len(parts):
            break
        x = parts[columns].to_numpy().ravel()[: 1 + 2 * model.flat().size]
        positions, (flat, of_sums) = int(x[0]), np.split(x[1:] / x[0], 2)
        model, sums = model.filled(flat), sums.filled(of_sums)
        shared.unpersist()
    return model, positions


def tables(model: Model, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, log of the normaliser): the log probability of w after
    classes h2, h1 is first[h1, w] + second[h2, w] - normaliser[h1, h2].  Made
    some rows at a time, so that nothing wider than the tables is held."""
    context, position, word, bias = (x.astype(np.float64) for x in (model.context, model.position, model.word, model.bias))
    k = len(bias)
    scores, shares, tops = [], [], []
    for i, add in ((0, bias), (1, 0.0)):
        score, share, top = np.empty((k, k), np.float32), np.empty((k, k), np.float32), np.empty(k)
        for at in range(0, k, rows):
            part = (context[at : at + rows] * position[i]) @ word.T + add
            top[at : at + rows] = part.max(1)
            score[at : at + rows], share[at : at + rows] = part, np.exp(part - part.max(1, keepdims=True))
        scores.append(score)
        shares.append(share)
        tops.append(top)
    normaliser = shares[0]  # each block of it is made from the same block of shares
    for at in range(0, k, rows):
        normaliser[at : at + rows] = np.log(shares[0][at : at + rows] @ shares[1].T) + tops[0][at : at + rows, None] + tops[1]
    return scores[0], scores[1], normaliser


def classes_for(v: int) -> int:
    return min(MOST_CLASSES, max(LEAST_CLASSES, CLASSES_BY_ROOT * isqrt(v)))


def hash_class(classes: Classes) -> Column:
    """The number among the hashed classes of a word that is not known."""
    return (F.crc32("w") % classes.hashed).cast("int")


def fitted(docs: DataFrame, frequent: int = FREQUENT, classes_wanted: int | None = None) -> tuple[DataFrame, dict]:
    """The counts of all training words (w, c), and what scoring needs: ``n``,
    ``v``, ``ends``, the ``classes``, the known words' ``count``, the tokens and
    distinct words of the hashed classes, all ``texts`` as ``encoded`` once for
    training and scoring (sums: of the base and of ``inner``), and the ``model``."""
    folded = fold(docs)
    training = folded.where("NOT held_out").select("t")
    counts = stash(word_counts(training), "lm-counts")
    got = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n, v = got.n + ends, got.v + (ends > 0)
    top = most_frequent(counts, frequent)
    count = np.array([r.c for r in top], np.float64)
    classes = Classes.deal([bytes(r.w) for r in top], count, got.n - count.sum(), classes_wanted or classes_for(v))
    count = count[: len(classes.of)]
    known = docs.sparkSession.createDataFrame([(w,) for w in classes.known], "w binary")
    hashed = np.zeros((classes.hashed, 2))
    for r in counts.join(F.broadcast(known), "w", "left_anti").groupBy(hash_class(classes).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        hashed[r.b] = r.c, r.v
    share = np.zeros(classes.size)
    np.add.at(share, classes.of, count)
    share[END], share[classes.first_hashed :] = ends, hashed[:, 0]
    share = (share + 0.5) / (share + 0.5).sum()
    weights = np.log10((count + 0.5) / smoothed_total(n, v)), inner(classes, count)
    texts = stash(encoded(folded, classes, weights), "lm-texts")
    copies = max(docs.sparkSession.sparkContext.defaultParallelism, n // COPY_POSITIONS)
    model, _ = train(texts.where("NOT held_out").coalesce(copies), classes, share)
    return counts, {"n": n, "v": v, "ends": ends, "classes": classes, "count": count, "hashed": hashed, "texts": texts, "model": model}


def smoothed_total(n: int, v: int) -> float:
    """What a smoothed count is divided by."""
    return float(n + 0.5 * (v + 1))


def inner(classes: Classes, count: np.ndarray) -> np.ndarray:
    """The log10 share of each known word in its class's tokens."""
    total = np.zeros(classes.size)
    np.add.at(total, classes.of, count)
    return np.log10(count / total[classes.of])


def score(docs: DataFrame, classes_wanted: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    counts, fit = fitted(docs, frequent, classes_wanted)
    n, ends, classes, hashed, texts = fit["n"], fit["ends"], fit["classes"], fit["hashed"], fit["texts"]
    below = smoothed_total(n, fit["v"])
    shared = spark.sparkContext.broadcast(tables(fit["model"]))
    base_end, known_end = float(np.log10((ends + 0.5) / below)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, normaliser = (x.ravel() for x in shared.value)
        k = len(shared.value[0])
        for b in batches:
            column, scores, tokens = b.column(b.schema.get_field_index("ids")), [], [np.zeros(0, np.int64)]
            for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                ids, lengths = _ids(column.slice(i, TEXTS_AT_ONCE))
                ids = ids.astype(np.int64)
                h1, h2, w = ids[1:-1], ids[:-2], ids[2:]
                logs = first.take(h1 * k + w).astype(np.float64) + second.take(h2 * k + w) - normaliser.take(h1 * k + h2)
                tokens.append(lengths - 2)
                ends = np.cumsum(lengths).tolist()  # the two positions between texts are of no text
                scores.extend(logs[at : end - 2].sum() for at, end in zip([0, *ends], ends, strict=False))
            by_name = {x: b.column(b.schema.get_field_index(x)) for x in ("uid", "doc_id", "held_out", "n_found", "sums")}
            yield pa.RecordBatch.from_arrays([*by_name.values(), pa.array(np.concatenate(tokens)), pa.array(np.array(scores) / np.log(10), pa.float64())], names=[*by_name, "n_tokens", "lm"])

    schema = "uid long, doc_id long, held_out boolean, n_found long, sums array<double>, n_tokens long, lm double"
    scored = texts.select("uid", "doc_id", "held_out", "n_found", "sums", "ids").mapInArrow(run, schema)
    # What the known words left: by word to its count, by row to sums.
    c = F.coalesce("c", F.lit(0))
    inside = F.element_at(F.lit((hashed[:, 0] + 0.5 * (hashed[:, 1] + 1)).tolist()), hash_class(classes) + 1)
    rest = texts.select("uid", F.inline("rare")).join(counts, "w", "left").select(
        "uid",
        F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0).alias("k_known"),
        (F.col("k") * F.log10((c + 0.5) / below)).alias("k_base"),
        (F.col("k") * F.log10((c + 0.5) / inside)).alias("k_lm"),
    )
    rest = rest.groupBy("uid").agg(*[F.sum(x).alias(x) for x in ("k_known", "k_base", "k_lm")])
    zero = lambda x: F.coalesce(x, F.lit(0))
    found = lambda i: F.element_at("sums", i)
    return scored.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_found") + known_end + zero("k_known")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (found(1) + base_end + zero("k_base")).alias("base_score"), (F.col("lm") + found(2) + zero("k_lm")).alias("score"),
    )
