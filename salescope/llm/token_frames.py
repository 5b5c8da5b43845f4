"""Token ids in files of independent zstandard frames with a seek table.

A file holds, in order: data frames, one index frame, a seek table. A data frame
is a zstandard frame of the little-endian unsigned 32-bit ids of some whole
documents (a document longer than FRAME_BYTES has a frame of its own). The index
is a zstandard skippable frame of fixed records, one per document: doc_id, frame
number, first id within the frame, number of ids, crc32 of the ids. The seek
table ends the file and is a skippable frame too, in the public zstandard
seekable layout: per frame compressed size, decompressed size and checksum (the
low 32 bits of XXH64 of the decompressed bytes), then the number of frames, a
flag byte and the magic number. Every zstandard tool can decompress such a file.

A reader fetches the seek table and the index from the file's end and then only
the frames of the documents it wants, checks each checksum and unpacks.

Cases: null and empty texts are written as the end id alone; a null doc_id is
written and read back as null; rows that repeat are written each, side by side;
extra columns are not read; an empty table gives no file and no row.
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
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from salescope.llm.common import new_folder, open_folder, small_batches, written
from salescope.llm.tokens import broadcast_tokenizer, worker_pieces

END_ID = 2
FRAME_BYTES = 1 << 18
SEEK_MAGIC = 0x8F92EAB1
SEEK_SKIPPABLE = 0x184D2A5E
INDEX_SKIPPABLE = 0x184D2A50
CHECKSUM_FLAG = 0x80
INDEX = np.dtype(
    [("doc_id", "<i8"), ("null_id", "<u4"), ("frame", "<u4"), ("first", "<u8"), ("count", "<u8"), ("crc", "<u4")]
)
_SEEK_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


class FrameWriter:
    """Writes documents one by one; holds one frame and the index of the file."""

    def __init__(self, sink) -> None:
        self._sink = sink
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._parts: list[bytes] = []
        self._size = 0
        self._index: list[tuple] = []
        self._frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._size and self._size + len(ids) > FRAME_BYTES:
            self._flush()
        key = (doc_id or 0, doc_id is None, len(self._frames), self._size // 4, len(ids) // 4, zlib.crc32(ids))
        self._index.append(key)
        self._parts.append(ids)
        self._size += len(ids)

    def _flush(self) -> None:
        data = b"".join(self._parts)
        packed = self._zstd.compress(data)
        self._sink.write(packed)
        self._frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._parts, self._size = [], 0

    def finish(self) -> None:
        if self._size:
            self._flush()
        index = np.array(self._index, INDEX).tobytes()
        self._sink.write(struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index)
        frames = np.array(self._frames, _SEEK_ENTRY)
        table = frames.tobytes()
        foot = struct.pack("<IBI", len(frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self._sink.write(struct.pack("<II", SEEK_SKIPPABLE, len(table) + len(foot)) + table + foot)


class FrameReader:
    """Reads the documents asked for; decompresses no other frame."""

    def __init__(self, source) -> None:
        """``source``: a seekable binary file."""
        self._source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        at = end - 9 - frames * _SEEK_ENTRY.itemsize
        source.seek(at)
        self.frames = np.frombuffer(source.read(frames * _SEEK_ENTRY.itemsize), _SEEK_ENTRY)
        self._starts = np.concatenate(([0], np.cumsum(self.frames["packed"].astype(np.int64))))
        source.seek(int(self._starts[-1]))
        kind, size = struct.unpack("<II", source.read(8))
        if kind != INDEX_SKIPPABLE:
            raise ValueError("no index after the last frame")
        self.index = np.frombuffer(source.read(size), INDEX)

    def frame(self, k: int) -> bytes:
        self._source.seek(int(self._starts[k]))
        packed = self._source.read(int(self.frames["packed"][k]))
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.frames["size"][k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.frames["checksum"][k]):
            raise ValueError(f"frame {k}: wrong checksum")
        return data

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids as bytes) of the index rows given, or of all, in file order."""
        last, data = -1, b""
        for r in self.index if rows is None else self.index[rows]:
            if int(r["frame"]) != last:
                last, data = int(r["frame"]), self.frame(int(r["frame"]))
            first = int(r["first"]) * 4
            yield (None if r["null_id"] else int(r["doc_id"])), data[first : first + int(r["count"]) * 4]


def write_frames(docs: DataFrame, folder: str, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` in ascending doc_id order (null first); one row per file: file, rank, n_docs, n_ids.

    A task writes under a name of its own and reports it, so that a task that
    runs twice leaves a file that no row names; the caller keeps the rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = broadcast_tokenizer(spark, tokenizer_path)
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    # Rows of one id need not meet in one task: text and place part them.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").sort(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = open_folder(folder)
        pieces, end = worker_pieces(tokenizer.value), struct.pack("<I", END_ID)
        name, writer, sink, n_docs, n_ids = f"part-{uuid.uuid4().hex}.tokens.zst", None, None, 0, 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if writer is None:
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    writer = FrameWriter(sink)
                ids = pieces.of(text) + end
                writer.add(doc_id, ids)
                n_docs += 1
                n_ids += len(ids) // 4
        if writer is not None:
            writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "rank": TaskContext.get().partitionId(), "n_docs": n_docs, "n_ids": n_ids}],
                schema=pa.schema(
                    [("file", pa.string()), ("rank", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
                ),
            )

    return ordered.mapInArrow(write, "file string, rank int, n_docs long, n_ids long")


def read_frames(files: DataFrame, folder: str) -> DataFrame:
    """Every document of the files named: doc_id, start (ids of all documents before it), ids (binary).

    ``files`` has one row per file, so its running sum is small; the documents
    are read and numbered within the tasks.
    """
    # One row per file, a file per task of the writer: thousands at 100 TB, not documents.
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as source:
                    yield from _batches(FrameReader(source), start)

    # A task per file: by number, since by key the few bytes would be put into one task.
    spread = placed.select("file", "before").repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def _batches(reader: FrameReader, start: int) -> Iterator[pa.RecordBatch]:
    """Documents in batches of about a megabyte, numbered from ``start``."""
    rows: list[tuple] = []
    held = 0
    for doc_id, ids in reader.documents():
        rows.append((doc_id, start, ids))
        start += len(ids) // 4
        held += len(ids)
        if held > 1 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
        ["doc_id", "start", "ids"],
    )


def read_documents(spark: SparkSession, folder: str, file: str, doc_ids: list[int]) -> list[tuple[int, bytes]]:
    """Only the documents asked for, of one file: the frames that hold them and no other."""
    fs, path = open_folder(folder)
    with fs.open_input_file(f"{path}/{file}") as source:
        reader = FrameReader(source)
        wanted = np.flatnonzero(np.isin(reader.index["doc_id"], doc_ids) & (reader.index["null_id"] == 0))
        return list(reader.documents(wanted))


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents, read the files back; doc_id, start, n_tokens, ids_crc32 from what was read."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-frames")
    files = written(write_frames(docs, folder, tokenizer_path), "token-files")
    return read_frames(files, folder).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
