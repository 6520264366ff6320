"""A bitmap that tells which rows may be in a table, so that others needn't be shuffled.

It is built in parts by the executors.  Its size follows the number of keys (16 bits each), up to ``MOST`` bits,
which bounds what is broadcast; false positives only cost work, and keys beyond that make it fill, so that more
rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.session import lean, partitions

#: Bits of the map at least and at most (sixteen megabytes), and of them in one row of its shuffle.
LEAST, MOST, ROW = 1 << 20, 1 << 27, 1 << 16


def size_for(keys: int) -> int:
    """Bits of a map for so many keys: a power of two."""
    return min(MOST, max(LEAST, 1 << (16 * keys).bit_length()))


def bitmap(rows: DataFrame, key: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The map of all rows' 64-bit keys, in ``size`` bits (a power of two)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            bits[(key(batch) & np.uint64(size - 1)).astype(np.int64)] = True
        parts = bits.reshape(-1, ROW)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([np.packbits(parts[i]).tobytes() for i in used.tolist()], pa.binary())], ["at", "bits"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[at] = held.get(at, np.uint8(0)) | np.frombuffer(bits, dtype=np.uint8)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["at", "bits"])

    schema = "at bigint, bits binary"
    made = rows.mapInArrow(lean(slots), schema).repartition(min(partitions(rows.sparkSession), size // ROW), "at").mapInArrow(lean(gather), schema)
    table = np.zeros((size // ROW, ROW // 8), dtype=np.uint8)
    for row in made.toLocalIterator():
        table[row["at"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return table.ravel()


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the map has the keys."""
    slot = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
