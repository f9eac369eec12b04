"""Set operations and distinct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of union, intersection and difference of two lists of customers, with and without repeats."""
    orders = read(spark, sf_dir, "orders")
    a, b = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"), orders.where("o_orderstatus = 'F'").select("o_custkey")
    parts = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total")).select(F.lit(name).alias("operation"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and type: the earliest, by an aggregate that is begun before rows are exchanged."""
    first = F.min(F.struct("ts", "event_id"))
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first.alias("first")).select("user_id", "event_type", "first.event_id")


QUERIES = {f.__name__: f for f in (set_operations, first_per_key)}

_PAIR = "select o_custkey from orders where o_orderpriority = '1-URGENT' {} select o_custkey from orders where o_orderstatus = 'F'"
_OPERATIONS = {"union": "union", "union_all": "union all", "intersect": "intersect", "intersect_all": "intersect all", "except": "except", "except_all": "except all"}

ORACLES = {
    "set_operations": " union all ".join(f"select '{name}' as operation, count(*) as n, sum(o_custkey)::bigint as total from ({_PAIR.format(sql)})" for name, sql in _OPERATIONS.items()),
    "first_per_key": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
}
