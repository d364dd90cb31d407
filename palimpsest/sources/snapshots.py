"""Snapshots of a replica's state as a data source: ``spark.read.format("snapshot")`` after ``register``.

A folder that is not there is an empty state. Reading needs nothing; writing needs ``auth``: without it a
replica only pulls. A write is seen whole or not at all: the files of a version lie in a folder of their
own, which the pointer names once all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ENTRY = "identity string, section string, key string, author string, clock long, value string, deleted boolean, deleted_at long"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in ENTRY.split(", "))])
#: Rows of a written group, which is what a task holds.
ROWS = 50_000


def _filesystem(path: str):
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


class PullOnlyError(PermissionError):
    """A snapshot was written without ``auth``."""


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        store, at = _filesystem(self.path)
        pointer = f"{at}/current"
        if store.get_file_info(pointer).type != arrow_fs.FileType.File:
            return [_File("")]
        with store.open_input_stream(pointer) as f:
            version = f.read().decode()
        found = store.get_file_info(arrow_fs.FileSelector(f"{at}/{version}", allow_not_found=True))
        return [_File(f.path) for f in found if f.path.endswith(".parquet")] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            store, _ = _filesystem(self.path)
            with store.open_input_file(partition.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=ROWS, columns=_ARROW.names)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, version: str):
        self.path, self.version = path, version

    def write(self, rows: Iterator) -> _Written:
        store, at = _filesystem(self.path)
        store.create_dir(f"{at}/{self.version}")
        name, held, writer = f"{uuid.uuid4().hex}.parquet", [], None
        for r in rows:
            held.append(r.asDict())
            if len(held) == ROWS:
                writer = writer or pq.ParquetWriter(f"{at}/{self.version}/{name}", _ARROW, filesystem=store)
                writer.write_table(pa.Table.from_pylist(held, _ARROW))
                held = []
        if held:
            writer = writer or pq.ParquetWriter(f"{at}/{self.version}/{name}", _ARROW, filesystem=store)
            writer.write_table(pa.Table.from_pylist(held, _ARROW))
        if writer:
            writer.close()
        return _Written(name if writer else None)

    def commit(self, messages: list) -> None:
        """Only files of tasks that were committed stay: those of attempts that were repeated go."""
        store, at = _filesystem(self.path)
        store.create_dir(f"{at}/{self.version}")
        named = {m.name for m in messages if m is not None}
        for f in store.get_file_info(arrow_fs.FileSelector(f"{at}/{self.version}")):
            if f.base_name not in named:
                store.delete_file(f.path)
        with store.open_output_stream(f"{at}/current.{self.version}") as f:
            f.write(self.version.encode())
        store.move(f"{at}/current.{self.version}", f"{at}/current")

    def abort(self, messages: list) -> None:
        store, at = _filesystem(self.path)
        if store.get_file_info(f"{at}/{self.version}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.version}")


class SnapshotSource(DataSource):
    """Options: ``path`` and, to write, ``auth``."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not self.options.get("auth"):
            raise PullOnlyError("a snapshot is pulled only: writing needs the option auth")
        if not overwrite:
            raise ValueError("a snapshot is the whole state: write it with mode overwrite")
        return _Writer(self.options["path"].rstrip("/"), f"v{uuid.uuid4().hex}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSource)
