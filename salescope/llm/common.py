"""What several operators share: the shared folder, words, word hashes, sessions."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a run of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())

#: Byte by byte: A-Z to a-z, word bytes kept, every separator to a blank. In
#: UTF-8 all bytes of a character beyond ASCII are at least 0x80.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: Rows of an Arrow batch: texts may be long, and a worker holds a batch or two.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small enough for very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one beside the warehouse's tables."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (path or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it of a folder given as a URI or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, and a scan of what was written."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, divisor: int):
    """crc32 of the id as decimal text, modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def word_list(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8, in order; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        steps = np.full(max(n, 1 << 16), _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _inverses = np.multiply.accumulate(steps)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of ``data`` where ``inside`` holds.

    The hash is the same in every process: a polynomial by prefix sums, the sum
    over a run shifted back to its start by the inverse power, without a loop.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * _powers[: len(data)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * _inverses[starts]
    return starts, ends, mixed(found + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES), np.uint8)
    return run_hashes(data, data != 32)[2]
