"""Event-time windows, the same code for tables and streams.

In all of them a row without a time is in no window; a null type, user or value
is a type or user like others, or adds nothing; a window without rows is not
given. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read

LATE = "2 hours"


def instants(events: DataFrame) -> DataFrame:
    """``ts`` as an instant in UTC, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "6 hours", step: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(events: DataFrame) -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(instants(read(spark, sf_dir, "events")))


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(instants(read(spark, sf_dir, "events")))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(instants(read(spark, sf_dir, "events")))


QUERIES = {f.__name__: f for f in (events_by_hour, events_sliding, session_windows)}

ORACLES = {
    "events_by_hour": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": """
        select start, count(*) as n from (
          select time_bucket(interval 2 hours, ts, timestamp '1970-01-01') - k * interval 2 hours as start from events, range(3) t(k)) group by 1
    """,
    "session_windows": """
        select user_id, min(ts) as start, count(*) as n from (
          select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (
            select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 1 else 0 end as fresh from events))
        group by user_id, s
    """,
}
