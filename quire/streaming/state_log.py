"""State tables fed by a stream: every micro-batch appends its latest write of each key.

Batches are idempotent (their number is part of the path), so a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quire.operators.state import latest


def feed(events: DataFrame, key: list[str], sequence: str, values: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps ``folder`` up to date with a stream of writes."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, sequence, *values, sequence).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str, key: list[str], sequence: str, values: list[str]) -> DataFrame:
    """The latest value of each key over all batches."""
    return latest(spark.read.parquet(folder), key, sequence, *values)
