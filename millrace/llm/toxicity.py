"""Toxicity: a linear classifier that is penalised for minding identity terms.

Features are the words of a text and their beginnings. Those that tell the
labels apart in a bounded sample of labelled texts are chosen, by exact 64-bit
hash, and weighted by logistic regression. Sentences of the sample that hold an
identity term are written anew with each other term of its group, and the
square of the change in score is penalised, so that a neutral mention of a
group does not count. All such pairs of the sample enter the penalty: those with
the same change of features are added up as one before they leave the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, giving_back, in_fold, release, table
from .words import NOT_ALNUM, Words, chunks, mix

#: Expected number of sampled training rows of each label. The classifier is
#: fitted on this bounded sample; a smaller table is used whole.
SAMPLE = {1: 4_000, 0: 8_000}
#: Least significance (standard errors of the log odds) and least number of texts of a feature.
SIGNIFICANCE, LEAST_TEXTS = 3.5, 4
#: Texts count as toxic from this score on.
THRESHOLD = 0.5
#: Weight of the squared weights, and of the squared changes by counterfactual swaps.
RIDGE, FAIRNESS = 0.02, 5.0
#: Terms of a table of identity terms at most: it is read by every task.
TERMS = 10_000

#: Groups of interchangeable identity terms.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives", "refugees"), ("frauen", "männer"), ("juden", "christen", "muslime"),
    ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)

_PREFIXES = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) for each occurrence of a feature in a chunk of texts."""
    w = Words(data, offsets, NOT_ALNUM, prefixes=_PREFIXES)
    doc, out = [w.doc], [w.hash]
    for k in _PREFIXES:
        (at,) = np.nonzero(w.prefix[k])
        doc.append(w.doc[at])
        out.append(w.prefix[k][at])
    return np.concatenate(doc), np.concatenate(out)


def _of(texts: list[str]) -> list[np.ndarray]:
    """Feature hashes of each of a few texts."""
    out: list[np.ndarray] = []
    for _, data, offsets in chunks(pa.array(texts, pa.string())):
        doc, f = features(data, offsets)
        out += [f[doc == i] for i in range(len(offsets) - 1)]
    return out


@dataclass(frozen=True)
class Linear:
    """Score: logistic of bias plus the weights of the features found, each times log2(1 + its count)."""

    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        if not len(self.hashes):
            return out
        doc, f = features(data, offsets)
        doc, at = self._chosen(doc, f)
        pairs, counts = np.unique(doc * len(self.hashes) + at, return_counts=True)
        return out + np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)] * np.log2(1 + counts), n)

    def _chosen(self, doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(1 << 20, dtype=bool)  # most features are none of the chosen
        seen[self.hashes & np.uint64((1 << 20) - 1)] = True
        (maybe,) = np.nonzero(seen[f & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, f[maybe]), len(self.hashes) - 1)
        found = self.hashes[at] == f[maybe]
        return doc[maybe][found], at[found]

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -700, 700))) for _, data, offsets in chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def column(self, text: Column) -> Column:
        """The score of each text, as a column."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            scores = model.score(texts)
            give_back()
            return pa.array(scores)

        return scored(text)


def terms(groups: DataFrame) -> tuple[tuple[str, ...], ...]:
    """The groups of a table ``(kind, term)`` of at most TERMS terms; terms of one kind can stand for each other.

    Null kinds and terms, empty terms and kinds of one term are left out; case does not matter.
    """
    rows = groups.select(F.col("kind").cast("string").alias("kind"), F.lower("term").alias("term")).where("kind is not null and term <> ''").distinct().limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"more than {TERMS} identity terms")
    kinds: dict[str, list[str]] = {}
    for r in rows:
        kinds.setdefault(r["kind"], []).append(r["term"])
    return tuple(tuple(sorted(kinds[k])) for k in sorted(kinds) if len(kinds[k]) > 1)


def swaps(text: str, groups=IDENTITY) -> Iterator[tuple[str, str]]:
    """Pairs of a sentence with an identity term and the sentence with another term of the group."""
    for sentence in re.split(r"(?<=[.!?\n])\s*", text):
        lower = sentence.lower()
        for group in groups:
            for term in group:
                if term in lower and re.search(rf"\b{re.escape(term)}\b", lower):
                    for other in group:
                        if other != term:
                            yield lower, re.sub(rf"\b{re.escape(term)}\b", lambda _, to=other: to, lower)


def sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int]) -> DataFrame:
    """``(text, y)`` of a sample, by hash of the id, of labelled rows that are not held out; distinct texts.

    The ids come from ``labels`` alone, each once (with label 1 if it has both),
    and their number is bounded by ``sizes``, so they may be sent to all
    executors.
    """
    training = labels.where(~in_fold(F.col("doc_id"), 5, 0) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in training.groupBy("y").agg(F.count("*").alias("n")).collect()}
    grain = 1 << 30
    share = [(F.col("y") == y) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(grain)) < int(grain * min(1.0, sizes[y] / n))) for y, n in counts.items()]
    ids = training.where(share[0] if len(share) == 1 else share[0] | share[1]) if share else training
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("y").alias("y")), counts


def _choose(texts: DataFrame, n: dict[int, int]) -> np.ndarray:
    """The significant features of a sample, sorted by hash."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy()
            for first, data, offsets in chunks(b.column(0)):
                doc, f = features(data, offsets)
                order = np.lexsort((f, doc))
                doc, f = doc[order], f[order]
                new = np.ones(len(f), dtype=bool)
                new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
                once, at = np.unique(f[new], return_inverse=True)
                positive = np.bincount(at, y[first + doc[new]], len(once)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(positive), pa.array(np.bincount(at, minlength=len(once)) - positive)], ["f", "a", "b"])

    got = texts.select("text", "y").mapInArrow(count, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    odds = lambda x, n: F.log((F.col(x) + 0.5) / (F.lit(n) - F.col(x) + 0.5))
    z = F.abs(odds("a", n[1]) - odds("b", n[0])) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    return np.sort(got.where(z >= SIGNIFICANCE).select("f").toArrow()["f"].to_numpy().astype(np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", groups=IDENTITY, sizes: dict[int, int] | None = None, fairness: float = FAIRNESS) -> Linear:
    """Fit on a sample of the labelled rows of ``docs`` that are not held out.

    ``groups`` are tuples of identity terms or a table as :func:`terms` takes
    it. Without an example of both labels the model gives all texts the share of
    label 1 (0.5 without any example).
    """
    groups = terms(groups) if isinstance(groups, DataFrame) else groups
    own, counts = sample(docs, labels, label, sizes or SAMPLE)
    texts = cut(own, "toxicity-sample")
    n = {y: 0 for y in (0, 1)} | {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        total = n[0] + n[1]
        share = min(max(n[1] / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    named = np.concatenate(_of([t for g in groups for t in g])) if groups else np.zeros(0, np.uint64)
    hashes = np.union1d(_choose(texts, n), named)
    chosen = Linear(hashes, np.zeros(len(hashes)), 0.0)

    @giving_back
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its label and the chosen features with their counts."""
        for b in batches:
            y = b.column(1).to_numpy()
            for first, data, offsets in chunks(b.column(0)):
                doc, at = chosen._chosen(*features(data, offsets))
                pairs, k = np.unique(doc * len(hashes) + at, return_counts=True)
                start = np.searchsorted(pairs // len(hashes), np.arange(len(offsets))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(start), pa.array(v)) for v in (pairs % len(hashes), np.log2(1 + k))]
                yield pa.RecordBatch.from_arrays([pa.array(y[first : first + len(offsets) - 1], pa.int32()), *lists], ["y", "at", "x"])

    @giving_back
    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each swap the chosen features whose value changes, and by how much, with the number of swaps alike."""
        for b in batches:
            found: Counter[tuple[tuple[int, ...], tuple[float, ...]]] = Counter()
            for text in b.column(0).to_pylist():
                for pair in swaps(text, groups):
                    values = []
                    for f in _of(list(pair)):
                        _, k = chosen._chosen(np.zeros(len(f), np.int64), f)
                        v = np.zeros(len(hashes))
                        np.add.at(v, k, 1)
                        values.append(np.log2(1 + v))
                    d = values[0] - values[1]
                    found[tuple(np.flatnonzero(d).tolist()), tuple(d[d != 0].tolist())] += 1
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64())), pa.array(list(found.values()), pa.int64())], ["at", "x", "k"])

    rows = texts.select("text", "y").mapInArrow(found, "y int, at array<long>, x array<double>").toArrow()
    pairs = texts.select("text").mapInArrow(changed, "at array<long>, x array<double>, k long").groupBy("at", "x").agg(F.sum("k").alias("k")).orderBy("at", "x").toArrow()
    release(texts)
    weights, bias = _regress(rows, pairs, len(hashes), fairness)
    # the sample's shares of the labels are not those of the table
    bias += np.log(counts[1] / counts[0]) - np.log(n[1] / n[0])
    return Linear(hashes, weights, float(bias))


def _sparse(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column and value of each entry."""
    at, x = (rows[name].combine_chunks() for name in ("at", "x"))
    lengths = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), at.flatten().to_numpy(), x.flatten().to_numpy()


def _regress(rows: pa.Table, pairs: pa.Table, width: int, fairness: float, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradients with Adam's step sizes."""
    y = rows["y"].to_numpy().astype(float)
    row, col, val = _sparse(rows)
    p_row, p_col, p_val = _sparse(pairs)
    share = pairs["k"].to_numpy() / max(1, pairs["k"].to_numpy().sum())
    params = np.zeros(width + 1)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, b = params[:-1], params[-1]
        logits = b + np.bincount(row, w[col] * val, len(y))
        off = (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - y) / len(y)
        grad = np.append(np.bincount(col, off[row] * val, width) + RIDGE * w / len(y) * 10, off.sum())
        if pairs.num_rows:
            change = np.bincount(p_row, w[p_col] * p_val, pairs.num_rows)
            grad[:-1] += fairness * 2 * np.bincount(p_col, (share * change)[p_row] * p_val, width)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:-1], params[-1]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    A null text counts as empty, and an empty text has the bias alone; null and
    repeated ids are scored row by row (a null id is not held out and trains
    nothing); a text labelled both ways counts as label 1; an empty table gives
    an empty one; other columns are ignored.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
