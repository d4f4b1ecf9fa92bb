"""Token ids as binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

File layout (all integers little-endian), one file per task, documents in ascending order of their id:

    frame, frame, ...        zstandard frames of token ids (unsigned 32-bit), cut at FRAME_BYTES of ids
    skippable frame 0        a compressed Arrow stream with the id and the token count of every document
    skippable frame E        seek table: compressed size, size, low 32 bits of xxh64 for each frame, then the footer

The seek table is the last thing in the file and follows the public "zstd seekable format", so any zstandard reader can
decompress the file as a whole, and a reader with the table fetches only the frames in which its documents lie.

Null texts are empty. Documents with equal or null ids are kept, in the order of (id, text), nulls first; each gets its
end id. An empty table makes no file and no row. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colforge.llm.common import materialize, prepare, shared_dir
from colforge.llm.encoder import encoder
from colforge.sources.arrow_ipc import _file_system

# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 20
LEVEL = 3


class FrameWriter:
    """Writes documents one after another; holds one frame of ids and the counts of the file's documents."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self._out, self._limit = stream, frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=LEVEL)
        self._waiting, self._table = bytearray(), []
        self.ids, self.counts = [], []

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(tokens) // 4)
        self._waiting += tokens
        while len(self._waiting) >= self._limit:
            self._frame(bytes(self._waiting[: self._limit]))
            del self._waiting[: self._limit]

    def _frame(self, data: bytes) -> None:
        packed = self._zstd.compress(data)
        self._out.write(packed)
        self._table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self._waiting:
            self._frame(bytes(self._waiting))
        sink = pa.BufferOutputStream()
        index = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        packed = self._zstd.compress(sink.getvalue().to_pybytes())
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        rows = b"".join(struct.pack("<III", *row) for row in self._table)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self._table), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class FrameReader:
    """Reads documents of one file; decompresses the frames that they lie in, and holds one frame at a time."""

    def __init__(self, source):
        self._in = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        head = size - 9 - 12 * frames - 8
        rows = np.frombuffer(self._at(head + 8, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self._rows = rows
        self._place = np.concatenate([[0], np.cumsum(rows[:, 0])])
        self._first = np.concatenate([[0], np.cumsum(rows[:, 1])])
        start = int(self._place[-1])
        packed = self._at(start + 8, head - start - 8)
        self.index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
        counts = self.index["n_tokens"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self._held, self._frame = -1, b""

    def _at(self, place: int, size: int) -> bytes:
        self._in.seek(place)
        return self._in.read(size)

    def _load(self, k: int) -> bytes:
        if k != self._held:
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self._place[k]), int(self._rows[k, 0])), max_output_size=int(self._rows[k, 1]))
            if len(data) != self._rows[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self._rows[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._held, self._frame = k, data
        return self._frame

    def parts(self, place: int) -> Iterator[bytes]:
        """The ids of the document at this place in the file, frame by frame."""
        at, end = 4 * int(self.starts[place]), 4 * int(self.starts[place + 1])
        k = int(np.searchsorted(self._first, at, "right")) - 1
        while at < end:
            stop = min(end, int(self._first[k + 1]))
            yield self._load(k)[at - int(self._first[k]) : stop - int(self._first[k])]
            at, k = stop, k + 1

    def tokens(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document with this id."""
        places = np.flatnonzero(self.index["doc_id"].to_numpy() == doc_id)
        return [np.frombuffer(b"".join(self.parts(int(p))), "<u4") for p in places]


def write_frames(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode `text` of every document and write files below `folder`, a path that all executors reach.

    Returns the manifest, one row per file: file_no (ascending with the ids), path, documents, tokens. A file is written
    under a name of its task attempt; only attempts that succeed are in the manifest, so a lost executor leaves at most a
    file that nobody reads. One range shuffle of the texts; each task holds one batch and one frame.
    """
    spark = prepare(docs.sparkSession)
    # From here on a column of its own for the order of the files: the partition number, ascending with the ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = "file_no int, path string, documents long, tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, writer, out = encoder(tokenizer), None, None
        end = struct.pack("<I", end_id)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, root = _file_system(folder)
                system.create_dir(root, recursive=True)
                part = batch.column("part")[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
                out = system.open_output_stream(f"{root}/{name}", compression=None)
                writer = FrameWriter(out, frame_bytes)
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), codes.encode(batch.column("text").to_pylist())):
                writer.add(doc_id, tokens + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file_no": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "documents": pa.array([len(writer.ids)], pa.int64()), "tokens": pa.array([sum(writer.counts)], pa.int64())}
            )

    return materialize(ordered.mapInArrow(write, schema))


def read_frames(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, file_no, place (its number in the file)."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so one window task; the files are as large as tasks are, the manifest is a few bytes for each.
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _file_system(row["path"])
                with system.open_input_file(path) as source:
                    reader = FrameReader(source)
                    for lo in range(0, reader.index.num_rows, 8192):
                        index = reader.index.slice(lo, 8192)
                        crcs = []
                        for place in range(lo, lo + index.num_rows):
                            crc = 0
                            for part in reader.parts(place):
                                crc = zlib.crc32(part, crc)
                            crcs.append(crc)
                        n = index.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [
                                index["doc_id"].combine_chunks(),
                                pa.array(reader.starts[lo : lo + n] + row["base"], pa.int64()),
                                index["n_tokens"].combine_chunks(),
                                pa.array(crcs, pa.int64()),
                                pa.array([row["file_no"]] * n, pa.int32()),
                                pa.array(range(lo, lo + n), pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file_no", "place"],
                        )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file_no int, place long"
    # The window has left all rows in one task; a file is a task again from here on. The number is given, since adaptive
    # execution would put the few bytes of the manifest, and with them all files, back into one task.
    spread = files.repartitionByRange(max(1, manifest.count()), "file_no")
    return spread.mapInArrow(read, schema)


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/colforge/tokens-{uuid.uuid4().hex}"
