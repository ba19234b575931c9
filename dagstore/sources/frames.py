"""Framed logs: a batch and streaming source, an append sink and a checkpoint sink.

A frame is the payload's length and its CRC-32, both 4 bytes little-endian, then the payload.  A log is a folder of
segment files and a manifest that names the live ones in order; the manifest is replaced by one rename, so a reader sees
the log before or after an append or a checkpoint, never between.  A segment that ends within a frame was torn by an
interrupted write: what is whole counts, the rest does not.  A whole frame whose CRC fails is corruption, which is an
error and never skipped, as every frame after it would be lost with it.

``register(spark)`` makes the format ``framelog`` known: columns segment, ordinal (of the frame in it), payload.  Paths
are whatever pyarrow's file systems open (a shared folder, HDFS, an object store).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = struct.Struct("<II")
HEADER_BYTES = 8
SCHEMA = "segment string, ordinal bigint, payload binary"
MANIFEST = "_manifest.json"


class CorruptLog(ValueError):
    pass


def encode_frame(payload: bytes) -> bytes:
    return HEADER.pack(len(payload), zlib.crc32(payload)) + payload


def read_frames(data: bytes) -> tuple[list[bytes], int]:
    """The payloads of all whole frames, and where the last of them ends."""
    found: list[bytes] = []
    at = 0
    while at + HEADER.size <= len(data):
        size, crc = HEADER.unpack_from(data, at)
        end = at + HEADER.size + size
        if end > len(data):
            break
        payload = bytes(data[at + HEADER.size : end])
        if zlib.crc32(payload) != crc:
            raise CorruptLog(f"CRC differs at byte {at}, after {len(found)} frames")
        found.append(payload)
        at = end
    return found, at


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> list[str]:
    """The live segments in order; without a manifest there are none."""
    where, root = _open(path)
    if where.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with where.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def _publish(path: str, segments: list[str]) -> None:
    """Replaces the manifest by a rename."""
    where, root = _open(path)
    name = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
    with where.open_output_stream(name) as f:
        f.write(json.dumps(segments).encode())
    where.move(name, f"{root}/{MANIFEST}")


def _segment(path: str, name: str) -> list[bytes]:
    where, root = _open(path)
    with where.open_input_stream(f"{root}/{name}") as f:
        return read_frames(f.read())[0]


@dataclass
class Segment(InputPartition):
    name: str

    def __init__(self, name: str):
        self.name = name
        super().__init__(name)


def _batches(path: str, part: Segment) -> Iterator[pa.RecordBatch]:
    """The segment's frames, in batches of a thousand."""
    payloads = _segment(path, part.name)
    for k in range(0, len(payloads), 1000):
        some = payloads[k : k + 1000]
        yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(some)), pa.array(range(k, k + len(some)), pa.int64()), pa.array(some, pa.binary())], names=["segment", "ordinal", "payload"])


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Segment(s) for s in _manifest(self.path)] or [Segment("")]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from _batches(self.path, partition)


class FrameStream(DataSourceStreamReader):
    """New segments as they are published; the offset is how many the manifest has named.  A checkpoint ends the stream's log."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        return {"segments": len(_manifest(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Segment(s) for s in _manifest(self.path)[start["segments"] : end["segments"]]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    order: int
    name: str


class FrameWriter(DataSourceWriter):
    """One segment a task, published together: appended to the log, or in its place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        context = TaskContext.get()
        where, root = _open(self.path)
        order, name = context.partitionId(), f"{uuid.uuid4().hex}.frames"
        where.create_dir(root, recursive=True)
        some = False
        with where.open_output_stream(f"{root}/{name}") as f:
            for row in iterator:
                f.write(encode_frame(bytes(row[0])))
                some = True
        if not some:
            where.delete_file(f"{root}/{name}")
        return Written(order, name if some else "")

    def commit(self, messages: list[Written]) -> None:
        where, root = _open(self.path)
        where.create_dir(root, recursive=True)
        old = _manifest(self.path)
        new = [m.name for m in sorted((m for m in messages if m and m.name), key=lambda m: m.order)]
        _publish(self.path, new if self.overwrite else old + new)
        for name in old if self.overwrite else ():
            where.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written]) -> None:
        where, root = _open(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{root}/{m.name}")


class FrameLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameLog)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """segment, ordinal and payload of every whole frame; a segment's place in the log is its place in the manifest."""
    register(spark)
    return spark.read.format("framelog").load(path)


def append_log(records: DataFrame, path: str, order: str) -> None:
    """Appends records (payload, order): a segment a partition, records in order within and across them."""
    register(records.sparkSession)
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = records.repartitionByRange(n, F.col(order)).sortWithinPartitions(order)
    sorted_.select("payload").write.format("framelog").mode("append").save(path)


def write_checkpoint(state: DataFrame, path: str) -> None:
    """Replaces the log by the frames of state (payload), at once."""
    register(state.sparkSession)
    state.select("payload").write.format("framelog").mode("overwrite").save(path)


def decode_files(files: DataFrame) -> DataFrame:
    """path, ordinal, payload and end of the frames of files as the binaryFile source gives them (path, content)."""
    ddl = "path string, ordinal bigint, payload binary, end bigint"

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payloads, _ = read_frames(content or b"")
                ends, at = [], 0
                for p in payloads:
                    at += HEADER_BYTES + len(p)
                    ends.append(at)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(payloads), pa.string()), pa.array(range(len(payloads)), pa.int64()), pa.array(payloads, pa.binary()), pa.array(ends, pa.int64())], names=["path", "ordinal", "payload", "end"])

    return files.select("path", "content").mapInArrow(run, ddl)
