"""Sharding by histogram sort.

Rows are ordered by a hash of their text, then by a hash of their id: equal
texts are neighbours. Splitters that cut this order into shards of near equal
bytes are found by counting, not by sampling: each round counts the exact bytes
below candidate boundaries in all partitions and narrows the interval around
each target, until the bytes below a splitter are within a tolerance of it. There
is one splitter between two shards, whatever the number of rows, so what the
driver gets depends on the number of shards alone. The rows are then exchanged
once, to parts of shards: a hash deals a shard's rows to parts of a bounded
size, each of which numbers its own rows from where the parts before it end.

Boundaries fall between groups of equal texts where the tolerance allows; a
group too large for that is cut, by the hash of the id.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Bytes below a splitter may differ from its target by this share of a shard.
TOLERANCE = 0.01
#: Candidate boundaries tried for each target in a round.
PROBES = 63
#: Rows of a part of a shard, which one task numbers; expected.
ROWS_PER_PART = 200_000

LEAST = -(1 << 63)
Bound = tuple[int, int]


def place(group: np.ndarray, tie: np.ndarray, bounds: list[Bound]) -> np.ndarray:
    """Number of boundaries (sorted) at or before each key (group, tie)."""
    high = np.array([b[0] for b in bounds], dtype=np.int64)
    low = np.array([b[1] for b in bounds], dtype=np.int64)
    first = np.searchsorted(high, group, "left")
    out = np.searchsorted(high, group, "right")
    (among,) = np.nonzero(first < out)  # some boundary lies within this very group
    for i in among:
        out[i] = first[i] + np.searchsorted(low[first[i] : out[i]], tie[i], "right")
    return out


def histogram(keys: DataFrame, bounds: list[Bound]) -> dict[int, dict]:
    """Exact bytes, least and greatest key of the rows in each interval between sorted boundaries.

    Each partition adds up its own rows; a row for each partition and interval
    that has rows is exchanged, and one for each interval goes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, tie, size = (c.to_numpy() for c in b.columns)
            at = place(group, tie, bounds)
            order = np.argsort(at, kind="stable")
            used, start = np.unique(at[order], return_index=True)
            if not len(used):
                continue
            g, t = group[order], tie[order]
            columns = [used, np.add.reduceat(size[order], start), np.minimum.reduceat(g, start), np.maximum.reduceat(g, start), np.minimum.reduceat(t, start), np.maximum.reduceat(t, start)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["at", "bytes", "min_group", "max_group", "min_tie", "max_tie"]
    parts = keys.select("group", "tie", "size").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    merged = parts.groupBy("at").agg(F.sum("bytes").alias("bytes"), *[F.min(n).alias(n) for n in names if n[:4] == "min_"], *[F.max(n).alias(n) for n in names if n[:4] == "max_"])
    return {r["at"]: r.asDict() for r in merged.collect()}


def _narrow(keys: DataFrame, targets: list[int], spans: dict[int, list[int]], group: dict[int, int] | None, tolerance: int) -> dict[int, list[int]]:
    """Rounds of counting until each span is as narrow as need be.

    ``spans[i]`` is [low, bytes below low, high, bytes below high] around
    target i, in group hashes or, with ``group``, in ties within that group. A
    span is done when one of its ends is within the tolerance of its target or
    when one key alone is left in it.
    """
    done: dict[int, list[int]] = {}
    key = "tie" if group else "group"
    while open_ := [i for i in spans if i not in done]:
        bounds: set[Bound] = set()
        for i in open_:
            lo, _, hi, _ = spans[i]
            probes = {lo + (hi - lo) * k // (PROBES + 1) for k in range(PROBES + 1)} | ({hi} if hi < -LEAST else set())
            bounds |= {(group[i], x) for x in probes} | {(group[i] + 1, LEAST)} if group else {(x, LEAST) for x in probes}
        order = sorted(bounds)
        found = histogram(keys, order)
        below, total = [], 0
        for j in range(len(order)):
            total += found[j]["bytes"] if j in found else 0
            below.append(total)
        for i in open_:
            at = bisect.bisect_right(below, targets[i]) - 1
            lo, at_lo = (order[at][1] if group else order[at][0]), below[at]
            inside = found.get(at + 1)
            if inside is None or at_lo == targets[i]:
                hi, at_hi = lo, at_lo
            else:
                lo, hi, at_hi = inside[f"min_{key}"], inside[f"max_{key}"] + 1, at_lo + inside["bytes"]
            spans[i] = [lo, at_lo, hi, at_hi]
            if hi - lo <= 1 or min(targets[i] - at_lo, at_hi - targets[i]) <= tolerance:
                done[i] = spans[i]
    return done


def splitters(keys: DataFrame, total: int, targets: list[int], tolerance: int) -> list[Bound]:
    """A boundary for each target number of bytes, at most ``tolerance`` off if the rows allow.

    Boundaries are first sought between groups; where both ends of the group
    at a target are too far from it, that group is cut at a tie.
    """
    out: dict[int, Bound] = {}
    group: dict[int, int] = {}
    spans: dict[int, list[int]] = {}

    def nearest(i: int, lo: int, at_lo: int, hi: int, at_hi: int) -> tuple[int, int]:
        return (lo, targets[i] - at_lo) if targets[i] - at_lo <= at_hi - targets[i] else (hi, at_hi - targets[i])

    for i, found in _narrow(keys, targets, {i: [LEAST, 0, -LEAST, total] for i in range(len(targets))}, None, tolerance).items():
        at, off = nearest(i, *found)
        if off <= tolerance:
            out[i] = (at, LEAST)
        else:
            group[i], spans[i] = found[0], [LEAST, found[1], -LEAST, found[3]]
    for i, found in _narrow(keys, targets, spans, group, tolerance).items():
        out[i] = (group[i], nearest(i, *found)[0])
    # a boundary past the last number stands one below the end of the numbers
    return sorted((min(g, -LEAST - 1), min(t, -LEAST - 1)) for g, t in out.values())


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``docs``.

    size is the text's bytes in UTF-8 plus 8, of a null text 8 (its crc32 is
    that of no bytes). Law ``bytes``: the shards' sums of sizes are near equal:
    each splitter is within ``tolerance`` of a shard of its target, or as near
    as a single row allows. Equal texts share a shard unless a splitter had to
    cut their group. Slots number a shard's rows from 0 without a gap. Rows
    equal in text and id are told apart by where they were read, so no
    number of them is too large. An empty table gives an empty one; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"), F.xxhash64(F.col(id_col)).alias("id_hash"), F.monotonically_increasing_id().alias("read")
    )
    keys = cut(rows.withColumn("tie", F.xxhash64("id_hash", "read")).drop("id_hash", "read"), "shard-keys")
    facts = keys.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    total = facts["bytes"] or 0
    targets = [total * k // shards for k in range(1, shards)]
    bounds = splitters(keys, total, targets, int(total / shards * tolerance)) if total else []

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = place(b.column(3).to_numpy(), b.column(4).to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "shard"])

    kind = docs.schema[id_col].dataType.simpleString()
    parts = max(1, -(-facts["n"] // (rows_per_part * shards)))
    placed = keys.mapInArrow(assign, f"doc_id {kind}, size long, text_crc32 long, group long, tie long, shard int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("group", "tie", F.lit(7)), F.lit(parts)).cast("int"))
    # one row for each part of a shard; those of a shard, a 200,000th of its rows, meet in one task
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    order = Window.partitionBy("shard", "part").orderBy("group", "tie")  # sorts on disk if need be
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)
