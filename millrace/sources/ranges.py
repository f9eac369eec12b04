"""A data source of one's own: consecutive numbers with their squares, made where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..tables import read

#: Rows of an Arrow batch.
BATCH = 65_536


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class NumbersReader(DataSourceReader):
    def __init__(self, start: int, end: int, parts: int):
        self.start, self.end, self.parts = start, end, parts

    def partitions(self) -> list[Slice]:
        cuts = [self.start + (self.end - self.start) * k // self.parts for k in range(self.parts + 1)]
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [Slice(self.start, self.start)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        for a in range(partition.start, partition.end, BATCH):
            n = np.arange(a, min(a + BATCH, partition.end))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(n * n)], ["n", "square"])


class Numbers(DataSource):
    """Options start (0), end and partitions (1); an empty range gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "numbers"

    def schema(self) -> str:
        return "n long, square long"

    def reader(self, schema) -> NumbersReader:
        start, end, parts = int(self.options.get("start", 0)), int(self.options["end"]), int(self.options.get("partitions", 1))
        if parts < 1 or end < start:
            raise ValueError("numbers need an end at or after the start and one partition at least")
        return NumbersReader(start, end, parts)


def numbers(spark: SparkSession, start: int, end: int, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(Numbers)
    return spark.read.format("numbers").option("start", start).option("end", end).option("partitions", partitions).load()


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the data source up to the greatest part key, beside the parts that have them."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    most = parts.agg(F.coalesce(F.max("p_partkey"), F.lit(0))).first()[0]
    return numbers(spark, 0, most + 1, max(1, most // 5000)).join(parts, F.col("n") == F.col("p_partkey")).select("n", "square", "p_size")


QUERIES = {"squares": squares}
ORACLES = {"squares": "select p_partkey as n, p_partkey * p_partkey as square, p_size from part"}
