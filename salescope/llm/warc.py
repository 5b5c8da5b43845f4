"""WARC archives and a chunked table of their records.

Writing: one archive per task and ARCHIVE_BYTES, each record a gzip member of
its own. A payload is the block of an HTTP response; a revisit record names the
record that holds an identical payload and carries the HTTP header only.

Reading: an archive is inflated piece by piece. A record becomes rows of a
record identifier and a chunk number with at most CHUNK_BYTES of payload and the
SHA-1 of the payload up to the chunk's end, so that no record is ever held as a
whole and the last row of a record has its size and digest. A digest that
differs from the one in the header is an error.

Cases: a null payload is empty; empty payloads have one chunk row of no bytes;
a null id is kept and never becomes the record that others refer to while
another has an id; of rows that repeat the referred id each is a response; a
null url leaves the target out; extra columns are not read; an empty table
gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salescope.llm.common import new_folder, open_folder, small_batches, written
from salescope.operators.joins import splittable_join

ARCHIVE_BYTES = 64 << 20
CHUNK_BYTES = 64 << 10
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
RECORD_ID = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to long, chunk_no long, "
    "data binary, bytes_so_far long, sha1_so_far string, last boolean"
)


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: store the payload).

    Only digests, sizes and ids are grouped. The join back is of the form that
    adaptive execution splits, as one payload may be that of a third of all pages.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    keepers = (
        rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and keeper is not null")
        .select("digest", "keeper")
    )
    joined = splittable_join(rows, keepers, ["digest"], "left")
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"),
    )


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_parts(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> Iterator[bytes]:
    """The record's bytes, piece by piece."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <{RECORD_ID}{'none' if page_id is None else page_id}>")
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%20" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{_base32(digest)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append("Content-Type: application/http; msgtype=response")
    block = len(http) + (len(payload) if refers_to is None else 0)
    lines.append(f"Content-Length: {block}")
    yield "\r\n".join([*lines, "", ""]).encode("utf-8", "replace") + http
    if refers_to is None:
        for at in range(0, len(payload), CHUNK_BYTES):
            yield payload[at : at + CHUNK_BYTES]
    yield b"\r\n\r\n"


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records; one row per archive: file, n_records. Names are never used twice."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    small_batches(decided.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        done, sink, size, count, name = [], None, 0, 0, ""
        for b in batches:
            for r in zip(*(b.column(c) for c in _WRITTEN), strict=True):
                if sink is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
                for part in record_parts(*(x.as_py() for x in r)):
                    packed = deflate.compress(part)
                    sink.write(packed)
                    size += len(packed)
                tail = deflate.flush()
                sink.write(tail)
                size, count = size + len(tail), count + 1
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    done.append((name, count))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, count))
        if done:
            names, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "n_records"]
            )

    return decided.select(*_WRITTEN).mapInArrow(write, "file string, n_records long")


_WRITTEN = ("page_id", "url", "payload", "digest", "refers_to")


def inflated(source, piece: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of consecutive gzip members, at most ``piece`` at a time."""
    inflate, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or source.read(piece)
        if not data:
            if not inflate.eof and inflate.unconsumed_tail:
                raise ValueError("the archive ends within a record")
            return
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        out = inflate.decompress(data, piece)
        rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if out:
            yield out


class _Stream:
    """Bytes by line and by count over an iterator of pieces; holds a piece or two."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self._pieces, self._held = pieces, b""

    def _more(self) -> bool:
        piece = next(self._pieces, None)
        if piece is None:
            return False
        self._held += piece
        return True

    def line(self) -> bytes:
        """Up to and without the next line end; empty at the end of all."""
        while (at := self._held.find(b"\r\n")) < 0:
            if not self._more():
                line, self._held = self._held, b""
                return line
        line, self._held = self._held[:at], self._held[at + 2 :]
        return line

    def some(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes; empty at the end of all."""
        if not self._held and not self._more():
            return b""
        out, self._held = self._held[:most], self._held[most:]
        return out

    def ended(self) -> bool:
        return not self._held and not self._more()


@dataclass
class _Record:
    fields: dict[str, str] = field(default_factory=dict)

    def id_of(self, name: str) -> int | None:
        value = self.fields.get(name, "").strip("<>").removeprefix(RECORD_ID)
        return int(value) if value not in ("", "none") else None


def _header(stream: _Stream) -> dict[str, str]:
    fields = {}
    while line := stream.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def chunk_rows(source) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA from an open archive; at most a chunk of payload is held."""
    stream = _Stream(inflated(source))
    while not stream.ended():
        if not stream.line().startswith(b"WARC/"):
            raise ValueError("a record doesn't start with its version")
        record = _Record(_header(stream))
        kind, left = record.fields["warc-type"], int(record.fields["content-length"])
        head = [stream.line() + b"\r\n"]  # status line, then the HTTP header
        http = {}
        while line := stream.line():
            head.append(line + b"\r\n")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            http[name.strip().lower()] = value.strip()
        left -= sum(map(len, head)) + 2
        declared = base64.b32decode(record.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        own = record.fields["warc-record-id"].strip("<>"), record.id_of("warc-record-id"), kind
        refers_to = record.id_of("warc-refers-to")
        if kind == "revisit":
            yield *own, refers_to, 0, b"", int(http["content-length"]), declared, True
        else:
            sha1, so_far, number, total = hashlib.sha1(), 0, 0, left
            while True:
                parts, room = [], min(CHUNK_BYTES, left)
                while room:
                    part = stream.some(room)
                    if not part:
                        raise ValueError("the archive ends within a record")
                    parts.append(part)
                    room -= len(part)
                data = b"".join(parts)
                left -= len(data)
                so_far += len(data)
                sha1.update(data)
                if not left and sha1.hexdigest() != declared:
                    raise ValueError(f"{own[0]}: the payload doesn't have its digest")
                yield *own, refers_to, number, data, so_far, sha1.hexdigest(), so_far == total
                number += 1
                if not left:
                    break
        stream.line(), stream.line()  # the two empty lines after a block


def read_chunks(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named; a task per archive."""
    types = [
        pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(),
    ]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for r in chunk_rows(source):
                        rows.append(r if with_data else (*r[:5], None, *r[6:]))
                        held += len(r[5]) if with_data else 0
                        if held > 16 * CHUNK_BYTES or len(rows) == 1000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # By number: by key, the few bytes of names would be put into one task.
    spread = archives.select("file").repartition(max(1, archives.count()))
    return spread.mapInArrow(read, CHUNK_SCHEMA)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back; one row per page from its record's last chunk."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    archives = written(write_archives(with_decisions(pages), folder), "warc-files")
    return (
        read_chunks(archives, folder, with_data=False)
        .filter("last")
        .select(
            "page_id",
            F.col("bytes_so_far").alias("payload_bytes"),
            F.col("sha1_so_far").alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
