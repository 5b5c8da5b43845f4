"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as
many of the full length as fit, then the binary digits of the rest, longest
first. Each piece is a sequence of its own, so that no sequence crosses
documents and none is padded; sequences of equal length form a bucket, from
which a trainer draws batches.

Cases: a null or empty text is the end id alone, one piece of length 1; a null
doc_id is kept; rows that repeat are packed each; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salescope.llm.common import small_batches
from salescope.llm.tokens import broadcast_tokenizer, worker_pieces

END_ID = 2
MAX_LENGTH = 4096


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two, at most ``longest``, that sum to ``n``, in falling order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian binary), doc_tokens, sequence_id, offset.

    One pass without a shuffle. ``sequence_id`` numbers the pieces by task and
    place in the task's input; it is stable where the rows of ``docs`` come in a
    stable order, as from files. ``length`` is the bucket: write the result
    partitioned by it to lay the buckets apart.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = broadcast_tokenizer(spark, tokenizer_path)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = worker_pieces(tokenizer.value), struct.pack("<I", END_ID)
        for b in batches:
            row, start, length, parts, total = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = pieces.of(text) + end
                n, at = len(ids) // 4, 0
                for size in piece_lengths(n, max_length):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    parts.append(ids[4 * at : 4 * (at + size)])
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(parts, pa.binary()),
                    pa.array(total, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long"
    )
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def packed_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``pack`` with the crc32 of the ids in place of the ids."""
    pieces = pack(docs, tokenizer_path)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def unpacked(pieces: list[tuple[int, int, bytes]]) -> dict[int, np.ndarray]:
    """Ids by document from (doc_id, start, ids); for tests and small exports."""
    by_doc: dict[int, list] = {}
    for doc_id, start, ids in pieces:
        by_doc.setdefault(doc_id, []).append((start, ids))
    return {d: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4") for d, p in by_doc.items()}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
