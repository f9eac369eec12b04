"""Tables written to the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session does not name one and has but this machine (local
    tests) is a temporary folder made, which is shared by construction.
    """
    global _own_dir
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="millrace-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster
            return


atexit.register(_delete_all)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    This ends the lineage: a lost executor costs nothing that was written.
    Tables are deleted when the driver ends, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def cut_by(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """Like :func:`cut`, as a table in ``parts`` buckets of ``key``: grouping it by the key moves no row."""
    spark = df.sparkSession
    known = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{known}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(known)
    _written.append((spark, path))
    out = spark.table(known)
    out._millrace_path, out._millrace_table = path, known
    return out


def again(df: DataFrame) -> DataFrame:
    """The table made by :func:`cut` read anew, so that it can be joined with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._millrace_path)
    out._millrace_path = df._millrace_path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` or :func:`cut_by` that no live DataFrame reads any more."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            if hasattr(df, "_millrace_table"):
                df.sparkSession.sql(f"drop table {df._millrace_table}")
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
