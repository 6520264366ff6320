"""Connected components of a table of edges by alternating large and small stars.

Each round is a few joins on the edge table, written to the shared folder, so lineage stays short and lost
executors cost one task each.  The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.session import drop, materialised


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("v", "u")).alias("b"))
    return moved.where("a <> b").distinct()


def stars(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node that has an edge and is no root.

    ``edges`` has columns a and b of one integer type.
    """
    now = materialised(edges.select("a", "b").where("a <> b").distinct(), folder, "edges0")
    seen = None
    for n in range(1, 200):
        now = materialised(_small(_large(now)), folder, f"edges{n}")
        drop(edges.sparkSession, f"{folder}/edges{n - 1}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
