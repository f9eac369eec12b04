"""Functions of one's own: scalar, aggregate, table, and over whole batches.

Values cross into Python as Arrow batches; those of the table function as rows,
which its ``eval`` takes one by one in any case. The aggregate is built from
partial sums, so that a group of any size is never held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..tables import read


@F.arrow_udf(StringType())
def initials(names: pa.Array) -> pa.Array:
    """The first letters of the words of each name; null for null."""
    return pc.replace_substring_regex(names.cast(pa.string()), r"([\pL\pN_])[\pL\pM\pN_]*\s*", r"\1")


@F.pandas_udf(DoubleType())
def haversine(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """Kilometres from (0, 0) to each point in degrees."""
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin(a / 2) ** 2 + np.cos(a) * np.sin(b / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(h))


def geometric_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, gmean)`` of the positive values of each key; null without any.

    Each batch hands on one row of sums for each of its keys.
    """
    kind = df.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            logs = np.log(b["value"].where(b["value"] > 0))
            yield logs.groupby(b["key"], dropna=False).agg(["sum", "count"]).reset_index()

    sums = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).mapInPandas(partial, f"key {kind}, sum double, count long")
    return sums.groupBy("key").agg(F.exp(F.try_divide(F.sum("sum"), F.sum("count"))).alias("gmean")).withColumnRenamed("key", key)


@F.udtf(useArrow=False)
class Streaks:
    """Stretches of rows of a table argument that have one value after another of a key: key, value, first, last, n.

    A polymorphic table function: the key's and the value's types are those of
    the table, which is dealt by key and sorted by order as ``analyze`` asks.
    State is one stretch, so a key may have any number of rows. Arguments: the
    table, and the names of its columns for key, order (shown as first and
    last) and value. Null values make stretches of their own.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        for name in (key, order, value):
            if name.value not in kinds:
                raise ValueError(f"the table has no column {name.value}")
        schema = StructType().add("key", kinds[key.value]).add("value", kinds[value.value]).add("first", kinds[order.value]).add("last", kinds[order.value]).add("n", "long")
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self):
        self.now = None

    def eval(self, row: Row, key: str, order: str, value: str) -> Iterator[tuple]:
        if self.now is not None and self.now[1] == row[value]:
            self.now = (*self.now[:3], row[order], self.now[4] + 1)
            return
        if self.now is not None:
            yield self.now
        self.now = (row[key], row[value], row[order], row[order], 1)

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None:
            yield self.now


def scalar_udfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = haversine(F.col("p_size").cast("double"), F.col("p_partkey").cast("double") % 90)
    return read(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("initials"), F.round(away, 3).alias("km"))


def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric_mean(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice").select("l_returnflag", F.round("gmean", 4).alias("gmean"))


def table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that follow each other in names, counted: a built-in table function does, so no Python runs."""
    w = F.split("p_name", " ")
    pairs = read(spark, sf_dir, "part").select(F.explode(F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("first"), F.slice(w, 2, F.size(w)).alias("second"))).alias("x"))
    return pairs.groupBy("x.first", "x.second").agg(F.count("*").alias("n"))


def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user of one type in a row, two at least, by a table function over the dealt and sorted table."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    found = Streaks(events.asTable(), F.lit("user_id"), F.lit("event_id"), F.lit("event_type"))
    return found.where("n >= 2").select(F.col("key").alias("user_id"), F.col("value").alias("event_type"), "first", "last", "n")


def batch_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price classes by a search in sorted borders, a batch at a time."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([1_000.0, 1_200.0, 1_500.0])
        for b in batches:
            at = np.searchsorted(borders, b.column(1).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at)], ["p_partkey", "class"])

    return read(spark, sf_dir, "part").where("p_retailprice is not null").select("p_partkey", "p_retailprice").mapInArrow(classes, "p_partkey long, class long")


QUERIES = {f.__name__: f for f in (scalar_udfs, aggregate_udf, table_udf, event_streaks, batch_udf)}

ORACLES = {
    "scalar_udfs": """
        select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') as initials,
          round(2 * 6371 * asin(sqrt(sin(radians(p_size) / 2) ** 2 + cos(radians(p_size)) * sin(radians(p_partkey % 90) / 2) ** 2)), 3) as km from part
    """,
    "aggregate_udf": "select l_returnflag, round(exp(avg(ln(l_extendedprice)) filter (l_extendedprice > 0)), 4) as gmean from lineitem group by 1",
    "table_udf": """
        select w[i] as first, w[i + 1] as second, count(*) as n
        from (select string_split(p_name, ' ') as w from part) x, lateral (select unnest(range(1, len(w))) as i) group by 1, 2
    """,
    "event_streaks": """
        select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from (
          select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events)
        group by user_id, event_type, g having count(*) >= 2
    """,
    "batch_udf": "select p_partkey, (p_retailprice >= 1000)::bigint + (p_retailprice >= 1200)::bigint + (p_retailprice >= 1500)::bigint as class from part where p_retailprice is not null",
}
