"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Counts, means
and covariances come from sums over all labelled training rows; each covariance
is shrunk towards a multiple of its own diagonal mean. A score is the posterior
from the difference of the Mahalanobis log densities, computed from inverses of
the Cholesky factors that are made once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import give_back, in_fold, table
from .words import Words, chunks

#: Weight of the target in a shrunk covariance.
SHRINKAGE = 0.05
#: Documents are kept from this score on.
THRESHOLD = 0.3

#: Bytes counted by class, and how many a word of plain prose has of each.
_CLASSES = {
    "symbols": (b"#*$%&|<>", 0.0),
    "shouts": (b"!", 0.0),
    "capitals": (bytes(range(65, 91)), 0.1),
    "digits": (bytes(range(48, 58)), 0.02),
    "lines": (b"\n", 0.02),
    "stops": (b".,;:?", 0.15),
}
#: Words of plain prose that are added to each text, so that a few words are no evidence.
_PRIOR = 10
_PRIOR_LENGTH, _PRIOR_SHORT = 6.0, 0.35
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, dtype=np.uint8)) for k, (v, _) in _CLASSES.items()}
#: Distances at which a repeated word is looked for.
_LAGS = (1, 2, 3, 4)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text of a chunk."""
    w = Words(data, offsets)
    n = w.counts()
    size = np.diff(offsets)
    letters = np.bincount(w.doc, w.length, w.n_docs)

    def share(count: np.ndarray, prior: float) -> np.ndarray:
        return np.sqrt(np.minimum(9.0, (count + _PRIOR * prior) / (n + _PRIOR)))

    columns = [np.log1p(n), share(letters, _PRIOR_LENGTH)]
    for name, mask in _MASKS.items():
        below = np.concatenate(([0], np.cumsum(mask[data])))
        columns.append(share(below[offsets[1:]] - below[offsets[:-1]], _CLASSES[name][1]))
    for lag in _LAGS:
        same = (w.hash[lag:] == w.hash[:-lag]) & (w.doc[lag:] == w.doc[:-lag])
        columns.append(share(np.bincount(w.doc[lag:][same], minlength=w.n_docs), 0.01))
    columns.append(share(np.bincount(w.doc[w.length <= 3], minlength=w.n_docs), _PRIOR_SHORT))
    columns.append(share(size - letters, 1.0))
    return np.column_stack(columns)


N_STATISTICS = 2 + len(_MASKS) + len(_LAGS) + 2


@dataclass(frozen=True)
class Discriminant:
    """Fitted classes; ``means[k]``, ``factors[k]`` (inverse Cholesky) and ``offsets[k]`` (log prior and volume)."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None  # the score of all rows where a class has no example

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def column(self, text: Column) -> Column:
        """The score of each text, as a column."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            parts = [model.score(statistics(data, offsets)) for _, data, offsets in chunks(texts)]
            give_back()
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        return scored(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = SHRINKAGE, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fit on all rows of ``docs`` that ``labels`` (id, label 0 or 1) has and that are not held out.

    A Bloom filter of the labelled ids leaves out most other texts. The rest are
    turned into statistics before the join, so only numbers are shuffled; two
    rows of sums come to the driver. Null ids and labels are left
    out; an id with both labels counts for both, a repeated label once. Where a class has no example the
    model gives all rows the share of label 1, or 0.5 without any example.
    """

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = [statistics(data, offsets) for _, data, offsets in chunks(texts)]
        give_back()
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATISTICS, dtype=np.int32)), pa.array(flat))

    training = labels.where(~in_fold(F.col(id_col), 5, 0) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    log2 = bloom.log2_blocks(training.count())
    id_ = F.col(id_col).cast("string")
    likely = bloom.may_hold(bloom.build(training.select(F.col("id").cast(docs.schema[id_col].dataType).cast("string").alias("key")), "key", log2), id_, log2)
    x = docs.where(~in_fold(F.col(id_col), 5, 0) & likely).select(F.col(id_col).alias("id"), stats(F.col(text_col)).alias("x")).join(training, "id")

    def sums(batches):
        total = {}
        for b in batches:
            m = b.column(1).flatten().to_numpy().reshape(-1, N_STATISTICS)
            y = b.column(0).to_numpy()
            for k in (0, 1):
                own = m[y == k]
                if len(own):
                    part = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                    total[k] = total.get(k, 0) + part
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["y", "at", "v"])

    got = x.select("y", "x").mapInArrow(sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    d = N_STATISTICS
    total = np.zeros((2, 1 + d + d * d))
    for r in got:
        total[r["y"], r["at"]] = r["v"]
    n = total[:, 0]
    if not n.all():
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        mean = total[k, 1 : 1 + d] / n[k]
        cov = total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + (shrinkage * max(np.trace(cov) / d, 1e-6)) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    A null text counts as empty and is scored like one; null and repeated ids
    are scored row by row (a null id is not held out and trains nothing); an
    empty table gives an empty one; other columns are ignored.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
