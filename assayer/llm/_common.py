"""Shared plumbing of the training-data operators.

Python stages are module-level functions, so that executors import them by name and keep their
caches between tasks; ``prepare`` puts the library's folder on the workers' path.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of an Arrow batch. Texts reach 100 kB and more, so batches are kept small.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import the library and keeps Arrow batches small."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        env.setdefault(name, "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives memory that this worker no longer uses back to the system; workers live on and allocators keep it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a worker that gives its memory back when a task ends."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Unset: an error, but for a local master, whose
    executors are in the driver's process; it takes a folder for temporary files."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "assayer-checkpoints")
    return f"{top.rstrip('/')}/assayer-{uuid.uuid4().hex}"


class Store:
    """Intermediate tables of one run: written once in the shared folder, read back without lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes written tables that nothing needs any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if folder.startswith(self.top) or f"/{self.top.rsplit('/', 1)[-1]}/" in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BLOCK = 1 << 19
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _factors(n: int) -> np.ndarray:
    """An odd factor for each place in a word, drawn one by one: they are in no ratio to each other, so no order of letters undoes them."""
    return np.random.default_rng(20240918).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


#: Factors of the places of the longest word so far.
_PLACES = [_factors(1 << 12)]


def _block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a block starts, and its hash: the sum of its bytes' numbers, each times the factor of its place in the word."""
    buf = np.frombuffer(data, np.uint8)
    edge = np.ones(len(buf) + 2, bool)
    edge[1:-1] = _SPACE[buf]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = at[::2], at[1::2]
    lengths = ends - starts
    longest = int(lengths.max(initial=0))
    if longest > len(_PLACES[0]):
        _PLACES[0] = _factors(1 << longest.bit_length())
    letters = np.flatnonzero(~edge[1:-1])
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_BYTE[buf[letters]] * _PLACES[0][place], out=sums[1:])
    to = np.cumsum(lengths)
    h = sums[to] - sums[to - lengths]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return starts, h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str | None], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower``: after A-Z became a-z."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        starts, h = _block_hashes(b"\n".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        out.extend(np.split(h, np.searchsorted(starts, ends)[:-1]))
        held.clear()

    for text in texts:
        data = utf8(text)
        if lower:
            data = data.lower()
        if size + len(data) > _BLOCK:
            flush()
            size = 0
        if len(data) > _BLOCK:
            out.append(_long(data))
            continue
        held.append(data)
        size += len(data) + 1
    flush()
    return out


def _long(data: bytes) -> np.ndarray:
    """Hashes of the words of a long text, in blocks that end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_block_hashes(data[at:end])[1])
        at = end
    return np.concatenate(parts)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two arrays of hashes."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> _S)) * _M1 + b
        return (x ^ (x >> _S)) * _M2


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` items; empty if there are fewer."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = mix(out, h[i : len(h) - n + 1 + i])
    return out ^ (out >> np.uint64(31))


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as differences of four bytes (eight where one is too large), and the counts over 1."""
    d = np.diff(values, prepend=np.uint64(0))
    more = np.flatnonzero(counts > 1).astype(np.uint32)
    wide = bool(len(d) and d.max() >> np.uint64(32))
    return np.array([wide, len(d), len(more)], np.uint32).tobytes() + d.astype(np.uint64 if wide else np.uint32).tobytes() + more.tobytes() + counts[more].astype(np.uint32).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    kind = np.dtype(np.uint64 if wide else np.uint32)
    at = 12 + n * kind.itemsize
    values = np.cumsum(np.frombuffer(blob, kind, n, 12), dtype=np.uint64)
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(blob, np.uint32, m, at)] = np.frombuffer(blob, np.uint32, m, at + 4 * m)
    return values, counts


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
