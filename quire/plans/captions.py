"""Captions of pictures as a relation: one call a picture, whatever the number of its uses, stored exactly once.

Pictures are told apart by a digest of their bytes and of what is asked; copies shrink to one row before the shuffle.
What the store has, refusals that last included, is not asked again.  Answers are written by tasks through Spark's
committer and published as one version of the store, so a task that runs again replaces its own rows and stores
nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.state import StateStore, pending

#: What a call gives: a caption, or an empty string for a refusal that lasts, or None for a failure that may pass.
Ask = Callable[[bytes, str], str | None]


def keyed(pictures: DataFrame, *scope: str) -> DataFrame:
    """``hash`` of pictures (content binary, media string): of their bytes, and of what else an answer depends on."""
    parts = F.concat_ws("\0", F.sha2("content", 256), "media", *map(F.lit, scope))
    return pictures.withColumn("hash", F.when(F.col("content").isNotNull(), F.sha2(parts.cast("binary"), 256)))


def describe(pictures: DataFrame, store: StateStore, ask: Ask, *scope: str, token: str | None = None) -> DataFrame:
    """``pictures`` with ``caption``: what the store has for each after asking once for each that it lacks; null where
    asking failed for now, or where there is no picture, and empty after a refusal that lasts."""
    rows = keyed(pictures, *scope)
    wanted = rows.where("hash is not null").groupBy("hash").agg(F.first("content").alias("content"), F.first("media").alias("media"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, media in zip(*(c.to_pylist() for c in batch.columns)):
                answer = ask(content, media)
                if answer is not None:
                    yield pa.RecordBatch.from_pydict({"hash": [key], "value": [answer]})

    answers = pending(wanted, store.read("captions"), ["hash"]).select("hash", "content", "media").mapInArrow(asked, "hash string, value string")
    store.write("captions", answers, token=token)
    return rows.join(store.read("captions").withColumnRenamed("value", "caption"), "hash", "left").drop("hash")
