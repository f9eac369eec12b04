"""Filling gaps in series of times, with values carried or interpolated from both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import read


def fill_gaps(df: DataFrame, keys: list[str], time: str, value: str, step_seconds: int) -> DataFrame:
    """A row for each step from the first to the last of each key: keys, ``time``, before, after, interpolated, filled.

    ``time`` is an instant at a whole number of steps and, with its keys, comes
    once. ``before`` and ``after`` are the values of the last known step up to
    the row and of the next from it on; ``interpolated`` lies between them by
    time, and ``filled`` tells rows that were not there. Each known row makes
    the rows up to the next one, so no spine is made or joined, and a series
    is one task only for the order of its known rows. Rows with a null time or
    value are left out; a null key is a key; no rows give none.
    """
    own = df.select(*keys, F.unix_seconds(time).alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null and _v is not null")
    order = Window.partitionBy(*keys).orderBy("_t")
    known = own.select("*", F.lead("_t").over(order).alias("_t1"), F.lead("_v").over(order).alias("_v1"))
    steps = F.sequence(F.lit(0).cast("long"), F.coalesce((F.col("_t1") - F.col("_t")) / step_seconds - 1, F.lit(0)).cast("long"))
    rows = known.select("*", F.explode(steps).alias("_k"))
    at, there = F.col("_t") + F.col("_k") * step_seconds, F.col("_k") == 0
    after = F.when(there, F.col("_v")).otherwise(F.col("_v1"))
    between = F.when(there, F.col("_v")).otherwise(F.col("_v") + (F.col("_v1") - F.col("_v")) * (F.col("_k") * step_seconds) / (F.col("_t1") - F.col("_t")))
    return rows.select(*keys, F.timestamp_seconds(at).alias(time), F.col("_v").alias("before"), after.alias("after"), between.alias("interpolated"), (~there).alias("filled"))


def hourly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value of the errors and purchases of some users in each hour, hours without any between those before and after (in full hundredths)."""
    events = read(spark, sf_dir, "events").where("event_type in ('error', 'purchase') and user_id < 20")
    hours = events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.max("value").alias("value"))
    filled = fill_gaps(hours, ["event_type"], "hour", "value", 3600)
    return filled.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "before", "after", F.floor(F.col("interpolated") * 100 + 1e-6).alias("hundredths"), "filled")


QUERIES = {"hourly_values": hourly_values}

ORACLES = {
    "hourly_values": """
        with h as (select event_type, date_trunc('hour', ts) as hour, max(value) as v from events where event_type in ('error', 'purchase') and user_id < 20 group by 1, 2),
        s as (select event_type, unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from h group by 1),
        p as (select s.event_type, s.hour, h.hour as h0, h.v as v0 from s asof join h on s.event_type = h.event_type and s.hour >= h.hour),
        n as (select p.*, h.hour as h1, h.v as v1 from p asof join h on p.event_type = h.event_type and p.hour <= h.hour)
        select event_type, hour, v0 as before, v1 as after, hour <> h0 as filled,
          floor(100 * case when h0 = h1 then v0 else v0 + (v1 - v0) * (epoch(hour) - epoch(h0)) / (epoch(h1) - epoch(h0)) end + 1e-6)::bigint as hundredths
        from n
    """
}
