"""Access to the tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst pushes filters and columns into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
