"""Stored tables: bucketed, partitioned and analysed, for plans that need fewer exchanges and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut_by, shared_dir
from ..tables import read

#: Buckets of the tables that the queries write.
BUCKETS = 16


def save_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Write a table in folders by a column; of a table that is there, the folders that ``df`` has rows for are replaced, no other."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def analysed(df: DataFrame, name: str) -> str:
    """Write a table, count its rows and the distinct values, least and greatest of its columns, and return the name it is known by."""
    known = f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(df.sparkSession)}/{known}").saveAsTable(known)
    df.sparkSession.sql(f"analyze table {known} compute statistics for all columns")
    return known


def by_cost(spark: SparkSession, text: str, on: bool = True) -> DataFrame:
    """Plan a statement with joins in the order that the statistics of its tables make cheap, in a session of its own."""
    planner = spark.newSession()
    for key in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.cbo.planStats.enabled"):
        planner.conf.set(key, str(on).lower())
    return planner.sql(text)


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders by priority; both tables lie in buckets of the order key, so the join moves no row."""
    lines = cut_by(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", BUCKETS, "lines")
    orders = cut_by(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", BUCKETS, "orders")
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def pruned_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a region from a table in folders by nation, of which one was replaced; folders of other regions are not read."""
    path = f"{shared_dir(spark)}/customers-{uuid.uuid4().hex}"
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    save_partitioned(customers, path, "c_nationkey")
    save_partitioned(customers.where("c_nationkey = 8").withColumn("c_acctbal", F.col("c_acctbal") * 2), path, "c_nationkey")
    nations = read(spark, sf_dir, "nation").where("n_regionkey = 2")
    return spark.read.parquet(path).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


STAR = """
    select n_name, count(*) as n, round(sum(l_quantity), 2) as quantity
    from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
    where n_regionkey = 1 and c_mktsegment = 'BUILDING' group by n_name
"""


def star_tables(spark: SparkSession, sf_dir: str) -> str:
    """The statement over tables that were written and analysed."""
    columns = {"lineitem": ("l_orderkey", "l_quantity"), "orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey", "c_nationkey", "c_mktsegment"), "nation": ("n_nationkey", "n_name", "n_regionkey")}
    return STAR.format(**{t: analysed(read(spark, sf_dir, t).select(*c), t) for t, c in columns.items()})


def star_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one segment and region; the join begins with the few customers, not in the order that it is written in."""
    return by_cost(spark, star_tables(spark, sf_dir))


QUERIES = {f.__name__: f for f in (bucketed_join, pruned_customers, star_by_cost)}

ORACLES = {
    "bucketed_join": "select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "pruned_customers": """
        select n_name, count(*) as n, round(sum(case when c_nationkey = 8 then 2 else 1 end * c_acctbal), 2) as balance
        from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 group by 1
    """,
    "star_by_cost": STAR.format(lineitem="lineitem", orders="orders", customer="customer", nation="nation"),
}
