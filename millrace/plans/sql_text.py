"""Queries given as SQL text over registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Plan a statement with the tables of a folder as views; ``{name}`` stands for a table."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


ABOVE_AVERAGE = """
    select o_orderkey, o_totalprice from {orders} o
    where o_totalprice > 2 * (select avg(i.o_totalprice) from {orders} i where i.o_orderpriority = o.o_orderpriority)
"""
BY_QUARTER = """
    with recursive quarters as (
      select cast(4 * (year(o_orderdate) - 1995) + quarter(o_orderdate) as bigint) as q, cast(sum(cast(round(o_totalprice) as bigint)) as bigint) as sold from {orders} group by 1),
    steps(q, total) as (
      select q, sold from quarters where q = 1 union all
      select n.q, s.total + n.sold from steps s join quarters n on n.q = s.q + 1)
    select q, total from steps
"""
BUSY_SUPPLIERS = """
    with counts as (select l_suppkey, count(*) as n from {lineitem} group by l_suppkey having count(*) > 500),
    named as (select s_name, n from counts join {supplier} on l_suppkey = s_suppkey)
    select s_name, n from named where n >= (select avg(n) from named)
"""


def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated subquery, which the planner turns into an aggregate and a join."""
    return run(spark, sf_dir, ABOVE_AVERAGE)


def recursive_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales up to each quarter, by recursion from one to the next."""
    return run(spark, sf_dir, BY_QUARTER)


def busy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, BUSY_SUPPLIERS)


QUERIES = {f.__name__: f for f in (above_average, recursive_steps, busy_suppliers)}


def _plain(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


ORACLES = {"above_average": _plain(ABOVE_AVERAGE), "recursive_steps": _plain(BY_QUARTER), "busy_suppliers": _plain(BUSY_SUPPLIERS)}
