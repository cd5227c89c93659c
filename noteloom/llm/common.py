"""Shared pieces: table access, saved intermediates, and byte-level hashing in numpy.

Executors may be lost at any time, so intermediates that cut lineage are written as Parquet below
``spark.checkpoint.dir``, a folder which the cluster's executors share.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that a scan would leave to fewer tasks than there are cores, as of one small file, are dealt to all; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Without one, a folder of this machine serves a session that runs on this machine alone, as in tests; on a cluster it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="noteloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


class Scratch:
    """Intermediate tables of one run. ``save`` cuts lineage; ``drop`` frees what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/noteloom-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.saved = 0
        atexit.register(self.clear)

    def save(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """With ``by``, rows lie in a folder for each value of that column, which ``drop`` takes as name/column=value."""
        self.saved += 1
        path = f"{self.root}/{name}-{self.saved}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes saved tables, or their parts, and lets Spark's cleaner free the shuffles of finished plans."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            whole, _, part = n.partition("/")
            p = jvm.org.apache.hadoop.fs.Path(f"{self.paths[whole]}/{part}" if part else self.paths.pop(whole))
            p.getFileSystem(conf).delete(p, True)
        self.release()

    def clear(self) -> None:
        """Deletes all that is left; results that are read later fail. Called when the driver ends."""
        with contextlib.suppress(Exception):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark notice that plans are done with, so that its cleaner frees their shuffles; results do not depend on it."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives a Python worker's freed memory back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions_for(total: int, each: int) -> int:
    """Enough partitions that each holds about ``each`` units; at least one."""
    return max(1, -(-int(total or 0) // each))


# ---------------------------------------------------------------- Arrow text


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes (uint8) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def row_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``limit`` bytes; a longer text stands alone."""
    offsets, _ = utf8(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow binary or string array over the bytes ``data`` cut at ``offsets``."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(salt) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 7)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


class Rolling:
    """64-bit hashes of any byte ranges of one buffer, after one linear pass.

    Each byte is replaced by a random 64-bit value and the values are summed with powers of an odd
    base; a range's sum is shifted back to its start, so equal byte strings get equal hashes wherever
    they stand. The result is mixed with the length.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        terms = _BYTE[data]
        terms *= powers(_BASE, n)
        np.cumsum(terms, out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        x = self.sums[hi]
        x -= self.sums[lo]
        x *= self.back[lo]
        x += (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(x)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        x = self.sums[size:] - self.sums[:n]
        x *= self.back[:n]
        return mix(x)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes 20 and 09 to 0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(offsets: np.ndarray, data: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and document indices; words never cross documents. ``gap`` marks separating bytes."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, docs


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ragged(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices lo[i] .. lo[i]+count[i]-1, one run after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - lo, count)
