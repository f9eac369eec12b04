"""Files of all built-in formats, read with a declared schema and written by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import cut, shared_dir
from ..tables import read

READERS = ("parquet", "orc", "csv", "json", "text")


def load(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of files; without a schema csv and json would be read twice to infer one, so they need it."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def load_checked(spark: SparkSession, path: str, kind: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Rows of csv or json files that fit the schema, and the text of those that do not (``bad``).

    A row is bad if a value cannot be read as its type, or if its form is
    broken; a missing value is a null. The files are read once, into a table
    that both results stand on, as bad rows show only where all columns are read.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"{kind} files have no malformed rows")
    rows = cut(spark.read.format(kind).schema(f"{schema}, _bad string").options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").load(path), "checked")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select(F.col("_bad").alias("bad"))


def load_merged(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Files whose schemas changed with time: all columns of any of them, null where a file lacks one."""
    if kind not in ("parquet", "orc"):
        raise ValueError(f"{kind} files hold no schemas")
    return spark.read.format(kind).option("mergeSchema", "true").load(path)


def save(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write files; rows of a partition column are gathered first, so that a folder has few files."""
    if partition_by:
        df = df.repartition(*partition_by)
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def load_stream(spark: SparkSession, path: str, kind: str, schema: str | StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that appear under a path."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as text, some with a price that is none and some with a broken line, read again: good rows by priority, and bad ones."""
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 97 == 0, "dear").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key, price, "o_orderpriority")
    orders.select(F.when(F.col("o_orderkey") % 101 == 0, F.concat(line, F.lit(",more,values"))).otherwise(line)).write.text(path)
    good, bad = load_checked(spark, path, "csv", "o_orderkey long, o_totalprice double, o_orderpriority string")
    good = good.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return good.unionByName(bad.select(F.lit("bad").alias("kind"), F.split("bad", ",")[0].cast("long").alias("key")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("key").alias("keys")))


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two times, the later with one column more and one less, as one table."""
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    parts = read(spark, sf_dir, "part")
    parts.where("p_size <= 25").select("p_partkey", "p_brand", "p_size").write.parquet(f"{path}/at=1")
    parts.where("p_size > 25").select("p_partkey", "p_brand", "p_type").write.parquet(f"{path}/at=2")
    return load_merged(spark, path).groupBy("at").agg(F.count("*").alias("n"), F.count("p_size").alias("sizes"), F.count("p_type").alias("types"), F.count_distinct("p_brand").alias("brands"))


QUERIES = {"checked_rows": checked_rows, "merged_rows": merged_rows}
ORACLES = {
    "checked_rows": """
        select case when o_orderkey % 97 = 0 or o_orderkey % 101 = 0 then 'bad' else o_orderpriority end as kind, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1
    """,
    "merged_rows": """
        select case when p_size <= 25 then 1 else 2 end as at, count(*) as n, count(*) filter (p_size <= 25) as sizes, count(*) filter (p_size > 25) as types, count(distinct p_brand) as brands
        from part group by 1
    """,
}
