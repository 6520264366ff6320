"""Session lookups of the training-data operators: shared folder, partition counts, Arrow batch size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are cut at this many bytes, so that long texts don't pile up in a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Caps the bytes of an Arrow batch unless the session already has a smaller cap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(str(spark.conf.get(key)).rstrip("bB"))
    except Exception:
        now = 1 << 62
    if now > BATCH_BYTES or now <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a worker's function: when a task ends, what it has freed goes back to the system, as workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a temporary folder is set, which ends with the process.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def materialised(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends here, and lost executors cost nothing."""
    spark = frame.sparkSession
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def places(parts: int, each: int) -> np.ndarray:
    """Whole numbers that Spark's hash partitioning deals evenly: ``each`` of them to each of ``parts``
    partitions, those of one partition side by side."""
    label = np.arange(parts * (each + 8) * 4, dtype=np.uint32)
    with np.errstate(over="ignore"):
        k = label * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    part = h.view(np.int32).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], np.arange(parts))
    return label[order[(first[:, None] + np.arange(each)).ravel()]].astype(np.int32)


def column(frame: DataFrame, name: str):
    """A column by its exact name, whatever other columns are called."""
    return frame[f"`{name}`"]


def free_names(keep: tuple[str, ...], made: tuple[str, ...]) -> None:
    """Kept columns must not have the names of columns that an operator makes, nor one name twice; as Spark
    compares names, without regard to case."""
    low, own = [c.lower() for c in keep], {c.lower() for c in made}
    taken = sorted({c for c in keep if c.lower() in own or low.count(c.lower()) > 1})
    if taken:
        raise ValueError(f"column names are taken: {taken}")
