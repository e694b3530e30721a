"""A log of committed batches that streams write to and read from, each row exactly once.

Beneath its folder, ``data`` has Arrow files, one a task and attempt, and ``commits`` one manifest a batch that names
the batch's files. A file counts once a manifest names it: files of failed attempts and of batches that never got
to their commit are never read. A writer's batch has a number; a batch that comes again after a failure finds its
manifest and changes nothing. A reader's offset is how many manifests it has gone through, in the order of their
numbers, and files never change, so what lies between two offsets is the same whenever it is read.

The folder may be in any store that pyarrow.fs knows by its URI; driver and executors must share it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType


class _Store:
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, top = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("/") else self.uri.replace("file:", "file://", 1))
        return system, f"{top}/{name}"

    def batches(self) -> list[int]:
        system, path = self.at("commits")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def files(self, batch: int) -> list[str]:
        system, path = self.at(f"commits/{batch:012d}.json")
        with system.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def publish(self, batch: int, files: list[str]) -> bool:
        """Whether this call made the manifest. It is written aside and moved, so it is there whole or not at all."""
        if batch in self.batches():
            return False
        system, path = self.at("commits")
        system.create_dir(path, recursive=True)
        aside = f"{path}/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(aside) as stream:
            stream.write(json.dumps(files).encode())
        system.move(aside, f"{path}/{batch:012d}.json")
        return True

    def delete(self, files: list[str]) -> None:
        for name in files:
            system, path = self.at(f"data/{name}")
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)


class _Written(WriterCommitMessage):
    def __init__(self, file: str | None) -> None:
        self.file = file


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, store: _Store) -> None:
        self.store = store

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        name, writer = f"{uuid.uuid4().hex}.arrow", None
        system, path = self.store.at("data")
        for batch in iterator:
            if writer is None:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}")
                writer = pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return _Written(None)
        writer.close()
        sink.close()
        return _Written(name)

    def commit(self, messages: list, batchId: int) -> None:
        files = [m.file for m in messages if m and m.file]
        if not self.store.publish(batchId, files):
            self.store.delete(files)

    def abort(self, messages: list, batchId: int) -> None:
        self.store.delete([m.file for m in messages if m and m.file])


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


def _rows(store: _Store, name: str) -> Iterator[pa.RecordBatch]:
    system, path = store.at(f"data/{name}")
    with system.open_input_stream(path) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


class _StreamReader(DataSourceStreamReader):
    def __init__(self, store: _Store) -> None:
        self.store = store

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        return {"seen": len(self.store.batches())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(name) for batch in self.store.batches()[start["seen"] : end["seen"]] for name in self.store.files(batch)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _rows(self.store, partition.name)

    def commit(self, end: dict) -> None:
        """Nothing is deleted: other readers may start later."""


class _Reader(DataSourceReader):
    def __init__(self, store: _Store) -> None:
        self.store = store

    def partitions(self) -> list[_File]:
        return [_File(name) for batch in self.store.batches() for name in self.store.files(batch)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _rows(self.store, partition.name) if partition.name else iter(())


class Ledger(DataSource):
    """Options: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        raise ValueError("a ledger is read with a schema")

    def _store(self) -> _Store:
        return _Store(self.options["path"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._store())

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self._store())

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a ledger can be appended to only")
        return _Writer(self._store())


def append(stream: DataFrame, path: str, checkpoint: str):
    """The started query that writes what is there of a stream to the ledger, then ends."""
    stream.sparkSession.dataSource.register(Ledger)
    query = stream.writeStream.format("ledger").outputMode("append").trigger(availableNow=True)
    return query.option("path", path).option("checkpointLocation", checkpoint).start()


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    spark.dataSource.register(Ledger)
    return spark.read.format("ledger").schema(schema).option("path", path).load()


def read_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    spark.dataSource.register(Ledger)
    return spark.readStream.format("ledger").schema(schema).option("path", path).load()
