"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words: the six ASCII white-space characters, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Few rows and few bytes an Arrow batch, since texts may be long: that bounds a worker's memory.

    Workers also get this package's place on their path, for sessions that were started elsewhere.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see, under spark.checkpoint.dir.

    Only where that setting is absent (tests on one machine) a local folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="intervalis-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing reads it any more; other tables stay."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def low_hashes(key: str, n: int, total: int) -> Column:
    """A condition that holds for little more than the n rows with the smallest hash of the key, of about total rows.

    Hashes are even, so that many rows are left however many partitions there are.
    """
    share = min(1.0, (2 * n + 100) / max(1, total))
    return F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(min(2**63 - 1, int(share * 2**63)))


def first_by_hash(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows with the smallest hash of the key, of about total rows."""
    return df.where(low_hashes(key, n, total)).orderBy(F.xxhash64(key), key).limit(n)


# The parameters of glibc's mallopt for the size from which memory is mapped, and for trimming.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1
_libc = None


def _lean_memory(map_from: int) -> None:
    """Arrays of map_from bytes or more are mapped and so given back when freed; Arrow takes its memory from malloc too."""
    global _libc
    if _libc is None:
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _libc = ctypes.CDLL(None)
            _libc.malloc_trim.argtypes = [ctypes.c_size_t]
            _libc.mallopt.argtypes = [ctypes.c_int, ctypes.c_int]
        except (OSError, AttributeError):  # another C library: its own rules hold
            _libc = False
    if _libc:
        _libc.mallopt(_MMAP_THRESHOLD, map_from)
        _libc.mallopt(_TRIM_THRESHOLD, 2 * map_from)


def _return_memory() -> None:
    if _libc:
        _libc.malloc_trim(0)


_forget: dict[str, Callable[[], None]] = {}


def forget_after(module: str, clear: Callable[[], None]) -> None:
    """What a module remembers in a worker is cleared once a task of another module begins there."""
    _forget[module] = clear


def _forget_others(module: str) -> None:
    for name, clear in _forget.items():
        if name != module:
            clear()


def lean(run, map_from: int = 4 << 20):
    """A function for mapInArrow whose worker gives free memory back to the system when a task ends.

    Mapping large arrays costs time each time one is made; operators of many large arrays and little else map fewer.
    """

    def task(batches):
        _lean_memory(map_from)
        _forget_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            _return_memory()

    return task


def lean_group(run):
    """The same for a function of key and rows for applyInArrow, after each group."""

    def group(key, rows):
        _lean_memory(4 << 20)
        _forget_others(run.__module__)
        try:
            return run(key, rows)
        finally:
            _return_memory()

    return group


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def arrow_batch(columns, schema: T.StructType):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and where it ends."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, dtype=np.int64)
    return first, np.append(first[1:], len(sorted_values))[: len(first)]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all items of runs, one run after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
