"""Joins of streams and state of one's own, and writing streams to files; the same code for tables where Spark allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import followed_within
from ..tables import read
from .event_time import LATE, instants


def followed_by(first: DataFrame, second: DataFrame, key: str = "user_id", within: str = "1 hour") -> DataFrame:
    """``(first_id, second_id)`` of events of a key where the second comes at or after the first, within a time.

    For streams both sides have watermarks and the time bound lets Spark drop
    state that nothing can meet any more. Columns: ``key``, ts, event_id.
    Within a key only rows of near times meet; a null key or time meets nothing.
    """
    return followed_within(first.withWatermark("ts", LATE), second.withWatermark("ts", LATE), key, within).select("first_id", "second_id")


def answered(first: DataFrame, second: DataFrame, key: str = "user_id", within: str = "1 hour") -> DataFrame:
    """Like :func:`followed_by`, with a null for a first event that nothing followed: a left outer join.

    A stream gives such an event once the watermark says that nothing can
    follow it any more, so the last ones of a stream that ends are held back.
    """
    return followed_within(first.withWatermark("ts", LATE), second.withWatermark("ts", LATE), key, within, "left").select("first_id", "second_id")


def streaks(events: DataFrame, length: int = 3) -> DataFrame:
    """A row each time a user has had ``length`` events of one type in a row: user_id, event_type, n (of such runs so far).

    Custom state for each user: the last type, how often it came in a row, and
    the number of runs. Events of a user within a batch are taken by time; an
    event that comes in a later batch counts as later.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, total = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        kinds = rows["event_type"].to_numpy(dtype=object)
        begins = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        ends = np.append(begins[1:], len(kinds))
        sizes = ends - begins
        sizes[0] += run if kinds[0] == last else 0  # the first stretch may go on with what the state holds
        times = sizes // length
        found = np.repeat(kinds[begins], times)
        state.update((str(kinds[-1]), int(sizes[-1] % length), total + len(found)))
        yield pd.DataFrame({"user_id": key[0], "event_type": found, "n": np.arange(total + 1, total + 1 + len(found))})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, n long", "last string, run int, total long", "append", GroupStateTimeout.NoTimeout)


def to_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write what there is of a stream to files, each row once, and return."""
    stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, use: Callable[[DataFrame, int], None]) -> None:
    """Call ``use(batch, number)`` for each batch of what there is of a stream; a repeated batch has the same number."""
    stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def clicks_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a click of the same user."""
    events = instants(read(spark, sf_dir, "events"))
    return followed_by(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"))


def errors_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the purchases of its user in the three hours after it, or none."""
    events = instants(read(spark, sf_dir, "events"))
    return answered(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), within="3 hours")


QUERIES = {"clicks_followed": clicks_followed, "errors_answered": errors_answered}
ORACLES = {
    "errors_answered": """
        select a.event_id as first_id, b.event_id as second_id from (select * from events where event_type = 'error') a
        left join (select * from events where event_type = 'purchase') b on a.user_id = b.user_id and b.ts >= a.ts and b.ts < a.ts + interval 3 hours
    """,
    "clicks_followed": """
        select a.event_id as first_id, b.event_id as second_id from events a join events b
          on a.user_id = b.user_id and b.ts >= a.ts and b.ts < a.ts + interval 1 hour
        where a.event_type = 'click' and b.event_type = 'purchase'
    """
}
