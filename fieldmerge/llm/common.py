"""What the operators of this package share: text buffers, word hashes and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts of a batch are worked on in blocks of about this many bytes, so memory follows the longest text only.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of
    our own; on a cluster, where executors couldn't see it, that fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldmerge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldmerge-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; each row is whole in one run."""
    data, at = text_buffer(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    made = []
    for base in (_BASE, inverse):
        p = np.full(1 << bits, base & _MASK, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    return made[0], made[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    return _powers(max(21, int(n + 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


#: A random value for each byte; in the second, A-Z equal a-z.
BYTE_VALUE, LOWER_VALUE = _byte_values(False), _byte_values(True)

#: Factors of a gram's words by their place; unrelated ones, so that no sum of some equals a sum of others.
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

#: The bytes that separate words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: All of ASCII but letters and digits: what separates words where punctuation doesn't matter.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[i for i in range(128) if not chr(i).isalnum()]] = True


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """n + 1 sums from which span_hash gets the hash of any byte range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes and lengths give equal hashes."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block (runs of bytes that aren't between words), A-Z lower-cased: hashes, start and end bytes, and the n + 1 word offsets of its rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(at), np.int64)
    solid = ~between[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = at[(at > 0) & (at < n)]
    before[inner], after[inner - 1] = False, False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    hashes = span_hash(prefix_sums(data, LOWER_VALUE), start, end)
    return hashes, start, end, np.searchsorted(start, at)


def word_grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k successive words within a row, the index of each gram's first word, and the n + 1 gram offsets of the rows."""
    count = np.diff(rows)
    per_row = np.maximum(count - k + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(per_row)))
    if offsets[-1] == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), offsets
    total = len(hashes) - k + 1
    sums = np.zeros(total, np.uint64)
    for j in range(k):
        sums += hashes[j : j + total] * _PLACE[j]
    first = np.arange(offsets[-1]) + np.repeat(rows[:-1] - offsets[:-1], per_row)
    return mix(sums[first]), first, offsets


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed long."""
    return x.view(np.int64)
