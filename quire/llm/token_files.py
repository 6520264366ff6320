"""Token-id files: Parquet list columns in document order, for selective reads of ids and of metadata.

Documents are range-partitioned and sorted by doc_id, encoded, and written as one file a range: ``ids`` as a
dictionary-encoded list column (delta-packed pages where the dictionary overflows), row groups and pages of
controlled size with page indexes, and beside the ids the columns ``doc_id``, ``n_tokens``, ``part`` and
``at`` (ids of the part before the row), so that counts and places are read without touching any id.

Defined results: null counts as the empty text, which holds the end id alone.  A missing doc_id comes first.
Rows of one doc_id are in the order of a hash of their text; rows alike in both are interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.pretokens import library_ids
from quire.llm.session import bounded_batches, column, lean, partitions

#: Bytes of a row group and of a page.
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 64 << 10
SCHEMA = "doc_id bigint, part int, n_tokens bigint, at bigint, ids array<int>"


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = 2, files: int | None = None) -> None:
    """Encodes every text, appends ``end_id`` and writes the files.

    The one shuffle is the range partitioning of the texts; Spark's committer publishes whole files, so lost
    executors are made good by their tasks alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranges = rows.repartitionByRange(files or partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, offsets = library_ids(path, batch.column(1))
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.diff(offsets)), pa.array(at + offsets[:-1]), lists], ["doc_id", "part", "n_tokens", "at", "ids"])
            at += int(offsets[-1])

    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.column.index.enabled": "true",
    }
    ranges.mapInArrow(lean(run), SCHEMA).write.mode("overwrite").options(**options).parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Rows of the files with ``start``, the ids of all documents before each; without ids no id page is read.

    The places of the parts are a table of one row a file, gathered from the metadata columns alone; it is
    broadcast, as its size is the number of files.
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    places, before = [], 0
    for part, n in totals:
        places.append((part, before))
        before += n
    own = F.broadcast(spark.createDataFrame(places, "part int, before bigint"))
    kept = files if with_ids else files.drop("ids")
    return kept.join(own, "part").withColumn("start", F.col("before") + F.col("at")).drop("before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(lean(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
