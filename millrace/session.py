"""Session factory with the settings the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings for any cluster. Partition counts follow the data: adaptive execution
#: starts from many and joins them up to the advisory size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``master`` only for local use, as a cluster's submit command names its own."""
    builder = SparkSession.builder.appName("millrace").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
