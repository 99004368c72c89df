"""Array views of text columns: word boundaries, hashes of spans and shared-folder tables.

Every operator of this subpackage that needs Python reads Arrow batches and
works on whole byte buffers with numpy; nothing here loops over words.
Slices of at most ``SLICE_BYTES`` of text (always at least one document, and
always whole documents) bound the memory of a task.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20

#: ASCII white space that ends a word: blank, tab, line feed, vertical tab, form feed, return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


mix = _mix


#: Spans of at most so many bytes are hashed by lanes, longer ones one by one.
LANED = 64
_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[s:e] of all spans.

    A span is mixed eight bytes at a time, each lane through a bijection that
    is not linear, so that no structure of a word cancels out as it does in
    sums of powers; a span of more than LANED bytes has a BLAKE2b digest.
    """
    size = ends - starts
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate((data, np.zeros(8, dtype=np.uint8))), strides=(1,))
    out = _mix(lanes[starts] & _LANE_MASKS[np.minimum(size, 8)] ^ _mix(size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    long = size > LANED
    for done in range(8, LANED, 8):
        more = np.flatnonzero((size > done) & ~long)
        if not len(more):
            break
        lane = lanes[starts[more] + done] & _LANE_MASKS[np.minimum(size[more] - done, 8)]
        out[more] = _mix(out[more] * _U(0x9E3779B97F4A7C15) ^ lane)
    if long.any():
        view = memoryview(np.ascontiguousarray(data))
        at = np.flatnonzero(long)
        out[at] = [int.from_bytes(hashlib.blake2b(view[s:e], digest_size=8).digest(), "little") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False
ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_a : _b + 1] = True


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of a text column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0], valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, end) document ranges of at most limit bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each document (n + 1 entries)."""
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = np.zeros(n + 1, dtype=bool)
    end[1:] = inside
    end[1:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = True):
    """Starts, ends, first word of each document and word hashes of a slice."""
    data = LOWER[data] if lower else data
    starts, ends, first = words(data, offsets, is_word)
    return starts, ends, first, span_hashes(data, starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the width-word shingles of each document.

    A document of fewer words, but not none, has its whole word sequence as
    its one shingle; without words the set is empty.
    """
    _, _, first, h = word_hashes(data, offsets)
    return [_shingles(h[first[i] : first[i + 1]], width) for i in range(len(first) - 1)]


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h)
    if not n:
        return h
    if n < width:
        out = n
        for x in h.tolist():
            out = (out * 0x9E3779B97F4A7C15 + x + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        return _mix(np.array([out], dtype=np.uint64))
    m = n - width + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + m]
    return np.unique(_mix(out))


# --- packed integers ----------------------------------------------------------------------------------------------------


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of integers, by planes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def spread(raw: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


# --- folders that driver and executors share ---------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[str] = []


def _local_root() -> str:
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="loomgraph-"))
    return _made[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/loomgraph/{re.sub(r'[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet into the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """df written in buckets of a column into the shared folder and read again, so that joins by that column don't move it.

    Buckets need an entry in the catalog to be written and resolved; it goes at once, the files stay.
    """
    spark = df.sparkSession
    table = f"loomgraph_{uuid.uuid4().hex}"
    df.write.bucketBy(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), column).option("path", shared_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch: bounds what a Python worker holds of texts of any length.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's bound of an Arrow batch to BATCH_BYTES, unless the session has a lower one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def remainder(column: str, by: int):
    """crc32 of an id as text, modulo by; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def parts_of(spark: SparkSession, least: int = 64) -> int:
    """Number of parts of a blob shuffle: follows spark.sql.shuffle.partitions."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
