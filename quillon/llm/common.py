"""Helpers shared by the training-data operators: shared storage and text vectors.

Text work is done on Arrow batches.  A batch's UTF-8 bytes are viewed as one numpy
array and cut into chunks of whole documents, so no per-word Python code runs.
Nothing is cut: a document longer than the chunk size makes a chunk of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset, one for tests, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() returned and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows and some 8 MB at most, which bounds what a task holds of texts on either side.

    This sets the session, since a DataFrame cannot carry it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def trim() -> None:
    """Give memory that the allocators of this worker hold but do not use back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def lean(run: Callable) -> Callable:
    """A mapInArrow function whose worker, which later tasks use again, trims its memory at the end of a task."""

    def out(batches):
        yield from run(batches)
        trim()

    return out


def lean_group(run: Callable, nbytes: int = 1 << 18) -> Callable:
    """An applyInArrow function that trims the worker's memory after each large group."""

    def out(key, t):
        large = t.nbytes > nbytes
        result = run(key, t)
        if large:
            del t
            trim()
        return result

    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


with np.errstate(over="ignore"):
    BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_BASE = 0x2545F4914F6CDD1D
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions 0..n-1."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 21)
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _POW.append(np.multiply.accumulate(x))
        del _POW[:-2]
    return _POW[0][:n], _POW[1][:n]


_NEAR = 64  # places whose values are in a table
with np.errstate(over="ignore"):
    _PLACED = mix(mix(np.arange(_NEAR * 256, dtype=np.uint64) * _GOLD) + _GOLD)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


class Chunk:
    """Whole documents as one byte array; off has the document bounds."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial hash of the bytes."""
        if self._prefix is None:
            up, _ = _powers(len(self.data) + 1)
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(BYTE_VALUE[self.data] * up[:-1], out=self._prefix[1:])
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each of the disjoint, ascending, non-empty byte strings [start, end).

        It sums a random value of each (place in the string, byte), so it has no algebra that
        makes long strings of a pattern collide.
        """
        n = end - start
        if not len(n):
            return np.zeros(0, np.uint64)
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64)
        byte = self.data[place + np.repeat(start - first, n)]
        place -= np.repeat(first, n)
        far = np.flatnonzero(place >= _NEAR)
        place <<= 8
        place += byte
        if len(far):
            beyond = place[far].astype(np.uint64)
            place[far] = 0
        value = _PLACED[place]
        with np.errstate(over="ignore"):
            if len(far):
                value[far] = mix(mix(beyond * _GOLD) + _GOLD)
            return mix(np.add.reduceat(value, first) + n.astype(np.uint64) * _GOLD)

    def window_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of each byte string [start, end); they may overlap, and should be of some hundred bytes at most."""
        p, (_, down) = self.prefix(), _powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of non-space bytes, and word bounds of documents."""
        solid = np.zeros(len(self.data) + 1, bool)
        np.logical_not(WHITE[self.data], out=solid[:-1])
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.off] = True
        before = np.zeros_like(solid)
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | edge))
        end = np.flatnonzero(before & (~solid | edge))
        return start, end, np.searchsorted(start, self.off)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each word but the last k-1 of the array."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _GOLD + words[i : i + n])
    return out


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """Document index of each item, from the bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string column; null has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, bounds, data = column.buffers()
    off = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def text_slices(b: pa.RecordBatch, column: int, size: int = 2 << 20):
    """Slices of a batch of whole rows, each with about size bytes of a string column."""
    _, off = batch_bytes(b.column(column))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def chunks(column: pa.Array, size: int = 1 << 20):
    """(first row, last row + 1, Chunk) over a string column, each of about size bytes."""
    data, off = batch_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to, Chunk(data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to
