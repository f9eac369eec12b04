"""A connector of one's own that reads, writes and streams: Arrow files and a list of what was committed.

A folder has ``data`` with one file for each task that wrote, and ``commits``
with one list of files for each batch, named by its number. Readers see
only files that a list names: a task or batch that fails leaves nothing to see,
and what it wrote is deleted. A batch that is committed already is not
committed again. Folders may be in any store that pyarrow reaches.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..shared import shared_dir
from ..tables import read


class Folder:
    """Paths and lists of a folder."""

    def __init__(self, uri: str):
        self.uri = uri

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)

    def lists(self) -> dict[int, list[str]]:
        """Files by number of the batch."""
        store, top = self.open()
        found = store.get_file_info(fs.FileSelector(posixpath.join(top, "commits"), allow_not_found=True))
        out = {}
        for f in found:
            if f.base_name.endswith(".json"):
                with store.open_input_stream(f.path) as s:
                    out[int(f.base_name[:-5])] = json.loads(s.read())
        return out

    def write(self, batches: Iterator[pa.RecordBatch], job: str = "") -> Wrote:
        """One task's file, named after its job; nothing is left of it if a batch fails."""
        store, top = self.open()
        store.create_dir(posixpath.join(top, "data"), recursive=True)
        name, rows = f"{job}{uuid.uuid4().hex}.arrow", 0
        path, writer, sink = posixpath.join(top, "data", name), None, None
        try:
            for b in batches:
                if writer is None:
                    sink = store.open_output_stream(path)
                    writer = pa.ipc.new_stream(sink, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
            if writer is not None:
                writer.close()
                sink.close()
        except BaseException:
            if sink is not None:
                sink.close()
                store.delete_file(path)
            raise
        return Wrote(name if rows else "", rows)

    def commit(self, messages: list[Wrote | None], number: int | None) -> None:
        """The list appears whole or not at all: it is written beside its place and moved there."""
        store, top = self.open()
        known = self.lists()
        if number in known:
            self.forget(messages)
            return
        number = max(known, default=-1) + 1 if number is None else number
        store.create_dir(posixpath.join(top, "commits"), recursive=True)
        beside = posixpath.join(top, "commits", f"{uuid.uuid4().hex}.tmp")
        with store.open_output_stream(beside) as s:
            s.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        store.move(beside, posixpath.join(top, "commits", f"{number}.json"))

    def forget(self, messages: list[Wrote | None]) -> None:
        store, top = self.open()
        for m in messages:
            if m is not None and m.name:
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(posixpath.join(top, "data", m.name))

    def forget_job(self, job: str) -> None:
        """Delete all files of a job, those of tasks that were stopped before they could tell of them, too."""
        store, top = self.open()
        for f in store.get_file_info(fs.FileSelector(posixpath.join(top, "data"), allow_not_found=True)):
            if f.base_name.startswith(job):
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(f.path)

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        store, top = self.open()
        with store.open_input_stream(posixpath.join(top, "data", name)) as s:
            yield from pa.ipc.open_stream(s)


@dataclass
class Wrote(WriterCommitMessage):
    name: str
    rows: int


class Piece(InputPartition):
    def __init__(self, name: str):
        self.name = name


class Writer(DataSourceArrowWriter):
    """``number``: the batch that this write is; without one it is a new one."""

    def __init__(self, folder: Folder, number: int | None):
        self.folder, self.number, self.job = folder, number, f"{uuid.uuid4().hex}-"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        return self.folder.write(iterator, self.job)

    def commit(self, messages: list) -> None:
        self.folder.commit(messages, self.number)

    def abort(self, messages: list) -> None:
        self.folder.forget_job(self.job)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: Folder):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        return self.folder.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.folder.commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.folder.forget(messages)


class Reader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        return [Piece(n) for _, names in sorted(self.folder.lists().items()) for n in names] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from self.folder.rows(partition.name)


class StreamReader(DataSourceStreamReader):
    """Offsets are numbers of batches: all below have been read."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"below": 0}

    def latestOffset(self) -> dict:
        return {"below": max(self.folder.lists(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(n) for k, names in sorted(self.folder.lists().items()) if start["below"] <= k < end["below"] for n in names] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from self.folder.rows(partition.name)

    def commit(self, end: dict) -> None:
        pass


class Chunks(DataSource):
    """Options path and, for writes, batch (a number); reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def _folder(self) -> Folder:
        if not self.options.get("path"):
            raise ValueError("chunks need a path")
        return Folder(self.options["path"])

    def reader(self, schema) -> Reader:
        return Reader(self._folder())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._folder())

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("chunks are only added to")
        return Writer(self._folder(), int(self.options["batch"]) if "batch" in self.options else None)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self._folder())


def save(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Add a table's rows to a folder; a ``batch`` that is there already adds nothing."""
    df.sparkSession.dataSource.register(Chunks)
    w = df.write.format("chunks").mode("append").option("path", path)
    (w if batch is None else w.option("batch", batch)).save()


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(Chunks)
    return spark.read.format("chunks").schema(schema).option("path", path).load()


def load_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of a folder's batches, as they are committed."""
    spark.dataSource.register(Chunks)
    return spark.readStream.format("chunks").schema(schema).option("path", path).load()


def events_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written in two batches, of which one is repeated, and read again: count and value by type."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for k in (0, 1, 1):
        save(events.where(F.col("event_id") % 2 == k), path, k)
    return load(spark, path, "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {"events_in_chunks": events_in_chunks}
ORACLES = {"events_in_chunks": "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1"}
