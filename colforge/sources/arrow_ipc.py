"""Arrow IPC files and streams as a Spark data source, read and written in parallel.

    spark.dataSource.register(ArrowIpc)
    spark.read.format("arrow_ipc").load(path)                      # IPC files, one task per record batch
    spark.read.format("arrow_ipc").option("layout", "stream")      # IPC streams, one task per `part_bytes` of batches
    df.write.format("arrow_ipc").mode("append").save(path)         # one part file per task

A stream has no directory of its batches. Its message headers are read first, body after body skipped, and tell where
the batches lie; a task then reads the schema, the dictionaries that came before its batches, and these batches.

Spark's times end at microseconds. Finer ones raise an error; `option("nanoseconds", "cut")` drops the digits beyond.
"""

from __future__ import annotations

import os
import struct
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import LongType, StringType, StructField, StructType

PART_BYTES = 16 << 20
OPENED_AT_ONCE = 16
# Fixed values of the IPC format: the marker before a message, and the kinds of header.
MARKER = 0xFFFFFFFF
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
POSITION = ("__file", "__batch", "__row")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowIpc)


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=False))
    names = (f.path for f in found if f.type == fs.FileType.File)
    return sorted(n for n in names if n.endswith((".arrow", ".arrows")) and not os.path.basename(n).startswith((".", "_")))


def _plain_type(kind: pa.DataType) -> pa.DataType:
    """The Arrow type Spark has: times as int64 microseconds, timestamps in microseconds, no dictionaries."""
    if pa.types.is_dictionary(kind):
        return _plain_type(kind.value_type)
    if kind == pa.uint64():
        return pa.decimal128(20, 0)
    if pa.types.is_time(kind) or pa.types.is_unsigned_integer(kind):
        return pa.int64()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_large_string(kind):
        return pa.string()
    if pa.types.is_large_binary(kind):
        return pa.binary()
    return kind


def _plain(batch: pa.RecordBatch, cut: bool = False) -> pa.RecordBatch:
    columns = []
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        kind = column.type
        try:
            if pa.types.is_time(kind):
                column = column.cast(pa.time64("us"), safe=not cut)
            column = column.cast(_plain_type(kind), safe=pa.types.is_timestamp(kind) and not cut)
        except pa.ArrowInvalid as e:
            raise ValueError(f"column {name} ({kind}) does not fit into microseconds; option nanoseconds=cut drops the digits beyond them") from e
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


@dataclass
class Message:
    kind: int
    start: int
    size: int


def _header(meta: bytes) -> tuple[int, int]:
    """Kind of header and size of the body, from a message's flatbuffer (fields 1 and 3 of its table)."""
    table = struct.unpack_from("<I", meta, 0)[0]
    fields = table - struct.unpack_from("<i", meta, table)[0]
    known = struct.unpack_from("<H", meta, fields)[0]

    def at(field):
        place = 4 + 2 * field
        return struct.unpack_from("<H", meta, fields + place)[0] if place < known else 0

    kind = meta[table + at(1)] if at(1) else 0
    return kind, struct.unpack_from("<q", meta, table + at(3))[0] if at(3) else 0


def stream_messages(f) -> list[Message]:
    """Where the messages of an IPC stream lie. Reads headers only; a stream that stops inside a message is an error."""
    found, at, end = [], 0, f.size()
    while at + 4 <= end:
        f.seek(at)
        lead = f.read(8)
        first = struct.unpack_from("<I", lead)[0]
        # Streams of before 2019 have no marker in front of the length.
        marked = first == MARKER
        if marked and len(lead) < 8:
            raise ValueError("the stream is cut off inside a message")
        length, skip = (struct.unpack_from("<I", lead, 4)[0], 8) if marked else (first, 4)
        if length == 0:
            return found
        f.seek(at + skip)
        meta = f.read(length)
        if len(meta) < length:
            raise ValueError("the stream is cut off inside a message")
        kind, body = _header(meta)
        size = skip + length + body
        if at + size > end:
            raise ValueError("the stream is cut off inside a message")
        found.append(Message(kind, at, size))
        at += size
    return found


class ArrowIpc(DataSource):
    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return path

    def _streams(self) -> bool:
        return self.options.get("layout", "file") == "stream"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self._path())
        if not files:
            raise ValueError(f"no Arrow files in {self._path()}")
        system, _ = _file_system(self._path())
        with system.open_input_file(files[0]) as f:
            found = (pa.ipc.open_stream(f) if self._streams() else pa.ipc.open_file(f)).schema
        plain = pa.schema([pa.field(c.name, _plain_type(c.type), c.nullable) for c in found])
        schema = from_arrow_schema(plain, prefer_timestamp_ntz=True)
        if self.options.get("position", "false").lower() == "true":
            kinds = (StringType(), LongType(), LongType())
            schema = StructType([*schema.fields, *[StructField(n, k, False) for n, k in zip(POSITION, kinds)]])
        return schema

    def reader(self, schema):
        cut = {"error": False, "cut": True}[self.options.get("nanoseconds", "error")]
        return _Reader(self._path(), self._streams(), schema, int(self.options.get("part_bytes", PART_BYTES)), cut)

    def writer(self, schema, overwrite):
        return _Writer(self._path(), overwrite)


@dataclass
class _Part(InputPartition):
    file: str
    batch: int
    before: list[Message] | None = None
    batches: list[Message] | None = None


class _Reader(DataSourceReader):
    def __init__(self, path, streams, schema, part_bytes=PART_BYTES, cut=False):
        self.path, self.streams, self.part_bytes, self.cut = path, streams, part_bytes, cut
        self.names = schema.fieldNames()

    def partitions(self):
        system, _ = _file_system(self.path)
        plan = self._stream_parts if self.streams else self._file_parts

        def parts(file):
            with system.open_input_file(file) as f:
                return plan(file, f)

        with ThreadPoolExecutor(OPENED_AT_ONCE) as pool:
            return [p for found in pool.map(parts, _files(self.path)) for p in found]

    def _file_parts(self, file, f):
        return [_Part(file, i) for i in range(pa.ipc.open_file(f).num_record_batches)]

    def _stream_parts(self, file, f):
        """Neighbouring batches up to `part_bytes` together; a dictionary between two batches starts a new part."""
        parts, before, last, seen = [], [], None, 0
        for m in stream_messages(f):
            if m.kind != BATCH:
                before, last = [*before, m], None
                continue
            if last is None or sum(b.size for b in last.batches) + m.size > self.part_bytes:
                last = _Part(file, seen, before, [])
                parts.append(last)
            last.batches.append(m)
            seen += 1
        return parts

    def read(self, partition):
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.file) as f:
            if not self.streams:
                yield self._finish(pa.ipc.open_file(f).get_batch(partition.batch), partition.file, partition.batch)
                return
            lead = [f.read_at(m.size, m.start) for m in partition.before]
            for i, m in enumerate(partition.batches):
                with pa.ipc.open_stream(pa.BufferReader(b"".join([*lead, f.read_at(m.size, m.start)]))) as stream:
                    yield self._finish(stream.read_next_batch(), partition.file, partition.batch + i)

    def _finish(self, batch, file, index):
        batch = _plain(batch, self.cut)
        if POSITION[0] in self.names:
            n = batch.num_rows
            extra = [pa.array([file] * n, pa.string()), pa.array([index] * n, pa.int64()), pa.array(range(n), pa.int64())]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *POSITION])
        return batch.select(self.names)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write hidden files; the commit makes them visible, so a lost or repeated task leaves nothing behind."""

    def __init__(self, path, overwrite):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        name, sink, writer = f"part-{uuid.uuid4().hex}.arrow", None, None
        for batch in iterator:
            if writer is None:
                sink = system.open_output_stream(f"{root}/.{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return _Written(None)
        writer.close()
        sink.close()
        return _Written(name)

    def commit(self, messages):
        system, root = _file_system(self.path)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                system.move(f"{root}/.{m.name}", f"{root}/{m.name}")
        for file in old:
            system.delete_file(file)

    def abort(self, messages):
        system, root = _file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/.{m.name}")
