"""Language-model scores: hashed maximum entropy with a class-factored softmax.

The probability of a token is that of its class given the history times that of
the token within its class. Classes are named by the end of a word, so unseen
words have one too. The first factor is a softmax over classes of the summed
weights of hashed features of the history: the word before (n-gram), its class,
the class of the word before that (skip), and the two together.

The second factor is a chain of softmaxes (:class:`Chain`): the commonest words
of a class or a rarer one; of the rarer ones the commonest or a still rarer one;
and so on. Each decision starts from the counts and adds hashed features of the
history: the word before (n-gram) and the word before that (skip), each with the
class and the place in the chain. The words that are left, however many, are
dealt to groups by hash, and the chain ends with such a decision between the
groups. Words of a group share what is left by their counts, and one place in
each group is kept for all that training has not seen, so that probabilities of
a history add up to one.

Counts come from all training texts. Feature weights are trained by gradient
updates that cover all training texts once: each round's gradients are added up
over the tasks and the driver takes one step. Scoring works on batches of tokens
as sparse numpy arrays: each distinct history of a batch is evaluated once.

The counts of the most frequent words, a bounded number, go to every executor.
Those of all others are joined by hash, so the vocabulary may be of any size.
Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, in_fold, table
from .words import Words, chunks, mix

#: Classes; number 0 is the end of a text.
CLASSES = 64
#: Buckets of the words of a class, as features.
BUCKETS = 32
#: Rows for pairs of the two words before.
PAIRS = 2048
#: Rounds of gradient updates; each has its own part of the training texts.
ROUNDS = 3
#: Added to the expected counts that scale a step, as smoothing.
DAMPING = 5.0
#: Tokens of a batch, and of a task's counts before they are handed on.
BATCH, HELD = 500_000, 2_000_000
#: Words whose counts are sent to all executors, at most; 16 bytes each.
FREQUENT = 1 << 19
#: Outcomes of a decision about a word, the last being any rarer one, and decisions about single words; groups of the words that are left.
FAN, LEVELS = 16, 2
#: Bits of the number of rows of the decisions' features: one row for so many training tokens, within limits.
ROW_BITS, TOKENS_A_ROW = (10, 16), 64
#: Tokens that decisions are made for together, and numbers that are added up together.
PART, WIDTH = 1 << 16, 1 << 14

END = np.uint64(0x2545F4914F6CDD1D)
_CONTEXTS = CLASSES * BUCKETS * CLASSES
#: First row of each kind of feature in the table of weights.
_WORD, _CLASS, _SKIP, _PAIR = 0, CLASSES * BUCKETS, CLASSES * BUCKETS + CLASSES, CLASSES * BUCKETS + 2 * CLASSES
_ROWS = _PAIR + PAIRS
_KINDS = 4


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, history, length of each text) of all tokens of a chunk, each text with its end."""
    w = Words(data, offsets)
    n = w.counts()
    last = w.start + w.length - 1
    tail = np.zeros(len(last), dtype=np.uint64)
    for k in range(3):
        tail = tail * np.uint64(257) + np.where(w.length > k, w.data[np.maximum(last - k, 0)], 0).astype(np.uint64) + np.uint64(k == 0)
    total = len(w.hash) + w.n_docs
    hash_, class_ = np.full(total, END), np.zeros(total, dtype=np.int64)
    at = np.arange(len(w.hash)) + w.doc
    hash_[at] = w.hash
    class_[at] = 1 + (mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64)
    bucket = class_ * BUCKETS + (hash_ % np.uint64(BUCKETS)).astype(np.int64) * (class_ > 0)
    before = np.concatenate(([0], bucket[:-1]))
    skip = np.concatenate(([0, 0], class_[:-2]))[:total]
    starts = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    skip[starts] = 0
    return hash_, class_, before * CLASSES + skip, n + 1


def _features(history: np.ndarray) -> list[np.ndarray]:
    """The rows of weights that a history adds up."""
    before, skip = history // CLASSES, history % CLASSES
    pair = (mix(history.astype(np.uint64) + np.uint64(7)) % np.uint64(PAIRS)).astype(np.int64)
    return [_WORD + before, _CLASS + before // BUCKETS, _SKIP + skip, _PAIR + pair]


def class_probabilities(weights: np.ndarray, bias: np.ndarray, history: np.ndarray) -> np.ndarray:
    """A row over classes for each history."""
    logits = bias + sum(np.take(weights, f, axis=0) for f in _features(history))
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=1, keepdims=True)
    return p


def contexts(hash_: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that, as hashes; the end of a text stands before its start."""
    before = np.concatenate(([END], hash_[:-1]))
    skip = np.concatenate(([END, END], hash_[:-2]))[: len(hash_)]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    skip[starts] = 0
    return before, skip


class Chain:
    """Words within their classes: ``FAN - 1`` of them to a decision, the commonest first, and the others by group.

    Words come with their class, place among the words of the class, and count;
    ``mass`` has for each class and group (the last bits of a word's hash) the
    number of tokens and one more for each word. What is unknown adds one to
    each group.
    """

    def __init__(self, word: np.ndarray, class_: np.ndarray, place: np.ndarray, count: np.ndarray, mass: np.ndarray, levels: int, bits: int):
        order = np.argsort(word)
        self.word, self.place, self.levels, self.bits = word[order], place[order], levels + 1, bits
        shares = np.zeros((CLASSES, levels + 1, FAN))
        shares[class_, place // (FAN - 1), place % (FAN - 1)] = count + 1.0
        left = mass.sum(axis=1) + FAN - np.cumsum(shares[:, :-1].sum(axis=2), axis=1).T  # after each decision
        shares[:, :-1, -1] = np.maximum(left.T, 0)
        groups = mass + 1.0
        np.subtract.at(groups, (class_, (word % np.uint64(FAN)).astype(np.int64)), count + 1.0)
        shares[:, -1] = np.maximum(groups, 1.0)
        some = shares[:, :, :-1].sum(axis=2) > 0
        some[0] = False  # the end is alone in its class
        self.decides = some.ravel()
        self.shares = (shares / np.maximum(shares.sum(axis=2, keepdims=True), 1)).reshape(-1, FAN).astype(np.float32)

    @staticmethod
    def bits_of(tokens: int) -> int:
        return min(max((tokens // TOKENS_A_ROW).bit_length(), ROW_BITS[0]), ROW_BITS[1])

    def decisions(self, weights: np.ndarray, hash_: np.ndarray, class_: np.ndarray, before: np.ndarray, skip: np.ndarray) -> Iterator[tuple]:
        """(tokens, rows of weights of each kind, outcome, summed weights, shares times their exponentials) of each part and decision."""
        odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - self.bits)
        for a in range(0, len(hash_), PART):
            h, c = hash_[a : a + PART], class_[a : a + PART]
            history = mix(before[a : a + PART] + np.uint64(1)), mix(skip[a : a + PART] + np.uint64(2))
            place = np.full(len(h), (self.levels - 1) * (FAN - 1))
            if len(self.word):
                near = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
                place = np.where(self.word[near] == h, self.place[near], place)
            for k in range(self.levels):
                node = c * self.levels + k
                (at,) = np.nonzero(self.decides[node] & (place >= k * (FAN - 1)))
                if not len(at):
                    continue
                outcome = np.minimum(place[at] - k * (FAN - 1), FAN - 1) if k < self.levels - 1 else (h[at] % np.uint64(FAN)).astype(np.int64)
                own = mix(node[at].astype(np.uint64) + np.uint64(1))
                rows = [(((x[at] ^ own) * odd) >> shift).astype(np.int64) for x in history]
                total = np.take(weights, rows[0], axis=0)  # much faster than brackets, for whole rows
                total += np.take(weights, rows[1], axis=0)
                e = np.exp(total)
                e *= np.take(self.shares, node[at], axis=0)
                yield a + at, rows, outcome, total, e

    def lifts(self, weights: np.ndarray, *tokens: np.ndarray) -> np.ndarray:
        """log10 of how much more probable the history makes each token within its class than counts alone."""
        out = np.zeros(len(tokens[0]), dtype=np.float32)
        for at, _, outcome, total, e in self.decisions(weights, *tokens):
            out[at] += total.ravel()[np.arange(0, total.size, FAN) + outcome] - np.log(np.einsum("nk->n", e))
        return out / np.float32(math.log(10))

    def gradients(self, weights: np.ndarray, out: np.ndarray, *tokens: np.ndarray) -> None:
        """Adds counts of outcomes to ``out``, of (found or expected, row, outcome)."""
        n = len(weights)
        expected, cells = np.zeros((FAN, n)), []
        for _, rows, outcome, _, e in self.decisions(weights, *tokens):
            e /= np.einsum("nk->n", e)[:, None]
            row = np.concatenate(rows)
            cells.append(row * FAN + np.tile(outcome, len(rows)))
            by_outcome = np.tile(e.T.astype(np.float64, order="C"), len(rows))
            for k in range(FAN):  # a row's numbers come in any order, so each outcome is counted by itself, without a sort
                expected[k] += np.bincount(row, by_outcome[k], n)
        if cells:
            out[0] += np.bincount(np.concatenate(cells), minlength=n * FAN).reshape(n, FAN)
            out[1] += expected.T


def chain(words: DataFrame, tokens: int, levels: int = LEVELS) -> Chain:
    """The chain of ``words(word, class, c)``; a bounded number of words of each class, and sums by group, come to the driver."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("c"), "word"))
    top = words.withColumn("place", rank).where(F.col("place") <= levels * (FAN - 1)).toArrow()
    mass = np.zeros((CLASSES, FAN))
    for r in words.groupBy("class", F.col("word").bitwiseAND(F.lit(FAN - 1)).alias("group")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        mass[r["class"], r["group"]] = r["n"]
    word, class_, place, count = (top[k].to_numpy() for k in ("word", "class", "place", "c"))
    return Chain(word.astype(np.int64).view(np.uint64), class_.astype(np.int64), place.astype(np.int64) - 1, count, mass, levels, Chain.bits_of(tokens))


def _batches(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """(first row, chunks of tokens) of about BATCH tokens at a time."""
    held, size, start = [], 0, 0
    for first, data, offsets in chunks(texts):
        if not held:
            start = first
        t = tokens(data, offsets)
        held.append(t)
        size += len(t[0])
        if size >= BATCH:
            yield start, held
            held, size = [], 0
    if held:
        yield start, held


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, class, c)`` of all tokens of ``docs(text)``; each task adds up its own before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, c, k = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, at = np.unique(h, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(np.bincount(at, k).astype(np.int64))], ["word", "class", "c"])

        for b in batches:
            for _, part in _batches(b.column(0)):
                h, c = np.concatenate([t[0] for t in part]), np.concatenate([t[1] for t in part])
                order = np.argsort(h)  # any place of a word will do, and a sort that is not stable takes half the time
                start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])[: len(h)])
                first, k = order[start], np.diff(np.append(start, len(h)))
                word = h[first]
                held.append((word, c[first], k))
                size += len(word)
                if size >= HELD:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()
            held.clear()
        give_back()

    return docs.select("text").mapInArrow(count, "word long, class int, c long").groupBy("word").agg(F.max("class").alias("class"), F.sum("c").alias("c"))


def add_classes(out: np.ndarray, used: np.ndarray, at: np.ndarray, class_: np.ndarray, p: np.ndarray) -> None:
    """Adds counts of classes to ``out``, of (found or expected, row, class).

    ``used`` are histories in ascending order, ``p`` the expected counts of each,
    ``at`` the place in ``used`` of each token's history.
    """
    features = _features(used)
    found = np.zeros(_ROWS * CLASSES, dtype=np.int64)
    for f in features:
        found += np.bincount(f[at] * CLASSES + class_, minlength=len(found))
    out[0] += found.reshape(_ROWS, CLASSES)
    by_word = np.zeros((CLASSES * BUCKETS, CLASSES), dtype=np.float32)
    start = np.flatnonzero(np.concatenate(([True], features[0][1:] != features[0][:-1])))
    by_word[features[0][start] - _WORD] = np.add.reduceat(p, start, axis=0)  # those of a word lie together
    out[1, _WORD:_CLASS] += by_word
    out[1, _CLASS:_SKIP] += by_word.reshape(CLASSES, BUCKETS, CLASSES).sum(axis=1)
    for f in features[2:]:
        order = np.argsort(f.astype(np.uint16), kind="stable")
        rows, start = np.unique(f[order], return_index=True)
        out[1, rows] += np.add.reduceat(np.take(p, order, axis=0), start, axis=0)


def _gradients(docs: DataFrame, weights: np.ndarray, bias: np.ndarray, links: Broadcast, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in ``docs(text)``, as found and as the weights expect them: (both, feature, class) and (both, row, outcome).

    Every task hands on its sums, in pieces of one size; pieces of up to 1,024
    tasks are added up together, and then the sums of those.
    """
    outer_size = 2 * _ROWS * CLASSES
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias, inner))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights_, bias_, inner_ = sent.value
        outer, within = np.zeros((2, _ROWS, CLASSES), np.float32), np.zeros((2, *inner_.shape), np.float32)
        some = False
        for b in batches:
            for _, part in _batches(b.column(0)):
                some = True
                hash_, class_, history, lengths = (np.concatenate([t[k] for t in part]) for k in range(4))
                links.value.gradients(inner_, within, hash_, class_, *contexts(hash_, lengths))
                times = np.bincount(history, minlength=_CONTEXTS)
                (used,) = np.nonzero(times)
                place = np.zeros(_CONTEXTS, dtype=np.int64)
                place[used] = np.arange(len(used))
                p = class_probabilities(weights_, bias_, used) * times[used, None].astype(np.float32)
                add_classes(outer, used, place[history], class_, p)
        if some:
            for first, both in ((0, outer.ravel()), (outer_size, within.ravel())):
                for k in range(0, len(both), WIDTH):
                    part = both[k : k + WIDTH]
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([TaskContext.get().partitionId() >> 10], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], ["at", "part", "v"])
        del outer, within
        give_back()

    def add(part: pa.Table) -> pa.Table:
        v = part["v"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).sum(axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"at": part["at"][:1], "part": part["part"][:1], "v": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))})

    schema = "at long, part int, v array<float>"
    parts = docs.select("text").mapInArrow(count, schema)
    got = parts.groupBy("at", "part").applyInArrow(add, schema).groupBy("at").applyInArrow(add, schema).toArrow()
    both = np.zeros(outer_size + 2 * inner.size, dtype=np.float32)
    for batch in got.to_batches():
        for k, v in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            both[k : k + len(v)] = v.values.to_numpy()
    sent.destroy()
    return both[:outer_size].reshape(2, _ROWS, CLASSES), both[outer_size:].reshape(2, *inner.shape)


def train(docs: DataFrame, bias: np.ndarray, links: Broadcast, rounds: int = ROUNDS, epochs: int = 1, id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of the chain after ``epochs`` of ``rounds`` updates; the rounds' parts of ``docs`` are together all of it.

    A step for classes is the gradient over its expected curvature, one for the
    chain the log of found over expected counts (iterative scaling), each
    divided by the number of features that act together.
    """
    weights = np.zeros((_ROWS, CLASSES), dtype=np.float32)
    inner = np.zeros((1 << links.value.bits, FAN), dtype=np.float32)
    for r in range(rounds * epochs):
        part = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(rounds)) == r % rounds)
        (found, expected), within = _gradients(part, weights, bias, links, inner)
        weights += np.clip((found - expected) / (expected + DAMPING), -0.99, 4.0) / _KINDS
        inner += np.log((within[0] + DAMPING) / (within[1] + DAMPING)) / 2
    return weights, inner


@dataclass(frozen=True)
class Model:
    """A fitted model; ``words`` is the table of all counts, ``n_class`` and ``v_class`` are tokens and words of each class."""

    words: DataFrame
    n_class: np.ndarray
    v_class: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    links: Broadcast
    inner: np.ndarray

    @property
    def total(self) -> int:
        return int(self.n_class.sum())

    @property
    def distinct(self) -> int:
        return int(self.v_class.sum())


def fit(training: DataFrame, rounds: int = ROUNDS, epochs: int = 1, levels: int = LEVELS) -> Model:
    """Fit on all rows of ``training(doc_id, text)``; without rows all counts are zero and all classes equally likely."""
    words = cut(count_words(training), "words")
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    total = int(n_class.sum())
    bias = np.log((n_class + 1) / (total + CLASSES)).astype(np.float32)
    links = training.sparkSession.sparkContext.broadcast(chain(words, total, levels))
    weights, inner = train(training, bias, links, rounds, epochs)
    return Model(words, n_class, v_class, bias, weights, links, inner)


def score(docs: DataFrame, folds: int = 7, held: int = 2, frequent: int = FREQUENT, **options: int) -> DataFrame:
    """Scores of each row of ``docs(doc_id, text)`` by a model of those of its rows that are not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (log10 of the smoothed unigram probability) and score (log10 of the
    model's). ``options`` are those of :func:`fit`. A null text counts as empty,
    and an empty text is its end alone. A row without an id is in no fold and so
    trains; repeated rows count and are scored one by one. An empty table gives
    an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = fit(own.where(~in_fold(F.col("doc_id"), folds, held)), **options)
    words, links, total, distinct = model.words, model.links, model.total, model.distinct

    # the least count of the frequent words, from a histogram of counts
    level = F.floor(8 * F.log2("c")).cast("int")
    histogram = sorted(((r["level"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, frequent
    for at, n in histogram:
        if n > room:
            break
        least, room = at, room - n
    chosen = words.where(level >= least) if least is not None else words.limit(0)
    top = chosen.select("word", "c").toArrow()
    hashes = np.asarray(top["word"].to_numpy(), dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[order], np.asarray(top["c"].to_numpy(), dtype=np.int64)[order], model.weights, model.bias, np.log10(model.n_class + model.v_class + np.where(np.arange(CLASSES) > 0, FAN, 1)), model.inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, w, bias_, size, inner_ = sent.value
        gain = np.log10(count + 1.0)
        u = TaskContext.get().partitionId() << 33
        for b in batches:
            for first, part in _batches(b.column(1)):
                h, class_, history, lengths = (np.concatenate([t[k] for t in part]) for k in range(4))
                n = len(lengths)
                doc = np.repeat(np.arange(n), lengths)
                times = np.bincount(history, minlength=_CONTEXTS)
                (used,) = np.nonzero(times)
                place = np.zeros(_CONTEXTS, dtype=np.int64)
                place[used] = np.arange(len(used))
                log_p = np.log10(class_probabilities(w, bias_, used)[place[history], class_])
                lift = links.value.lifts(inner_, h, class_, *contexts(h, lengths))
                word, at = np.unique(h, return_inverse=True)
                if len(known):
                    near = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    is_known = known[near] == word
                    value = np.where(is_known, gain[near], 0.0)
                else:
                    is_known, value = np.zeros(len(word), bool), np.zeros(len(word))
                found = is_known[at]
                value_model = np.bincount(doc, log_p - size[class_] + lift, n)
                rest = np.flatnonzero(~found)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc[rest], minlength=n)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(u, u + n, dtype=np.int64)), b.column(0).slice(first, n), pa.array(lengths.astype(np.int64)), pa.array(np.bincount(doc, value[at], n)), pa.array(np.bincount(doc[found], minlength=n).astype(np.int64)), pa.array(value_model), lists],
                    ["u", "doc_id", "n_tokens", "gain", "known", "model", "rare"],
                )
                u += n
        give_back()

    rows = cut(own.mapInArrow(run, f"u long, doc_id {kind}, n_tokens long, gain double, known long, model double, rare array<long>"), "scored")
    joined = rows.select("u", F.explode("rare").alias("word")).join(words.select("word", "c"), "word")
    extra = joined.groupBy("u").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more_gain"), F.count("*").alias("more_known"))
    gain = F.col("gain") + F.coalesce("more_gain", F.lit(0.0))
    n_known = F.col("known") + F.coalesce("more_known", F.lit(0))
    return rows.drop("rare").join(extra, "u", "left").select(
        "doc_id",
        in_fold(F.col("doc_id"), folds, held).alias("held_out"),
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (gain - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (gain + F.col("model")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
