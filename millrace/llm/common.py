"""Helpers shared by the operators: table access, joins with hot keys and fold rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import again, cut, cut_by, release, shared_dir  # noqa: F401

#: A key with at least one HOT-th of the rows is hot; there are HOT hot keys at most.
HOT = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has each key once, where a few keys may have most of the rows.

    ``weight`` is a column of ``keyed`` (which the result lacks): the rows of a
    key, ``total`` in all. The keys with a HOT-th of them or more, HOT at most,
    are sent to all tasks, so their rows stay where they are; the other rows
    are shuffled by key. A null key has no partner and is not shuffled either.
    ``keyed`` is written first unless it is a table of :func:`cut`.
    """
    keyed = keyed if hasattr(keyed, "_millrace_path") else cut(keyed, "keyed")
    is_hot = F.col(weight) * F.lit(HOT) >= F.lit(total)
    some = rows.where(F.col(key).isNotNull())
    if keyed.where(is_hot).isEmpty():
        out = some.join(keyed.drop(weight), key, how)
    else:
        hot, cold = keyed.where(is_hot).drop(weight), again(keyed).where(~is_hot).drop(weight)
        known = some.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
        out = known.where("is_hot").drop("is_hot").unionByName(known.where("is_hot is null").select(*rows.columns).join(cold, key, how))
    if how == "left":
        alone = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema if f.name not in (key, weight)])
        out = out.unionByName(alone)
    return out


def give_back() -> None:
    """Return the memory that a task has freed to the system.

    Workers of earlier stages stay alive, and what each of them keeps for later
    adds up within an executor. Without glibc nothing happens.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches that ends with :func:`give_back`, when nothing of its own is held any more."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def in_fold(doc_id: Column, folds: int, rest: int) -> Column:
    """True where the id is in the fold; a null id is in none."""
    return F.coalesce(fold(doc_id, folds) == rest, F.lit(False))
