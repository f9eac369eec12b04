"""Numbers for the rows of a whole table in a sorted order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_IN_PART = (1 << 33) - 1


def numbered(df: DataFrame, *keys: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``rn``: 0, 1, ... by the keys, nulls first; rows equal in all keys are in any order, but a fixed one.

    Rows are dealt to ranges of the keys, sorted there and written once, so that
    a number never changes; the driver gets one count for each range. Keys
    should end with what tells most rows apart: rows equal in all of them
    share one range. Sampling for the ranges plans ``df`` twice.
    """
    spark = df.sparkSession
    written = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rn", F.monotonically_increasing_id()), name)
    part = F.shiftright("rn", 33)
    counts = sorted(map(tuple, written.groupBy(part.alias("part")).count().collect()))
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, before long")
    joined = written.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("rn", F.col("before") + F.col("rn").bitwiseAND(F.lit(_IN_PART))).select(*written.columns)
