"""Window functions, ordering and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import read


def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    by_segment = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(by_segment).cast("long").alias("rk"), F.dense_rank().over(by_segment).cast("long").alias("dr"),
        F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"),
    )


def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.lag("event_type", 1, "none").over(w).alias("before"), F.lead("event_id").over(w).alias("next_id"), F.nth_value("event_id", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second_id"))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.count("*").over(w.rowsBetween(-1, 1)).alias("near"))


def range_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the six hours up to each event, by a range frame over seconds."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return read(spark, sf_dir, "events").select("event_id", "user_id", seconds.alias("us")).select("event_id", F.count("*").over(w).alias("n"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").orderBy("p_retailprice", "p_partkey").offset(50).limit(25).select("p_partkey", "p_name")


QUERIES = {f.__name__: f for f in (rank_in_group, lag_lead, running_totals, range_frames, top_orders, second_page)}

ORACLES = {
    "rank_in_group": """
        select c_custkey, row_number() over w as rn, rank() over s as rk, dense_rank() over s as dr, ntile(4) over w as quarter,
          round(percent_rank() over w, 8) as pr, round(cume_dist() over w, 8) as cd from customer
        window w as (partition by c_nationkey order by c_acctbal desc, c_custkey), s as (partition by c_nationkey order by c_mktsegment)
    """,
    "lag_lead": """
        select event_id, lag(event_type, 1, 'none') over w as before, lead(event_id) over w as next_id,
          nth_value(event_id, 2) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as second_id
        from events window w as (partition by user_id order by ts, event_id)
    """,
    "running_totals": """
        select o_orderkey, round(sum(o_totalprice) over (w rows between unbounded preceding and current row), 2) as so_far,
          round(sum(o_totalprice) over (w rows between 2 preceding and current row), 2) as last_three, count(*) over (w rows between 1 preceding and 1 following) as near
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)
    """,
    "range_frames": "select event_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as n from events",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100",
    "second_page": "select p_partkey, p_name from part order by p_retailprice, p_partkey limit 25 offset 50",
}
