"""Progress and usage as observed metrics: sums of columns that Spark takes along with a job's own rows.

A metric is counted from the tasks whose rows count, so a task that runs again is not counted twice, as it would be by
an accumulator; it is there once the job has ended, without another pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Metrics:
    """Observations by name; a name that is watched again is replaced."""

    def __init__(self) -> None:
        self._known: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, name: str, **sums: Column) -> DataFrame:
        """The same rows; once an action on them has ended, ``of(name)`` gives the aggregates."""
        self._known[name] = seen = Observation(name)
        return rows.observe(seen, *(c.alias(k) for k, c in sums.items()))

    def of(self, name: str) -> dict:
        """The aggregates of an action that has ended; waits for one that runs."""
        return dict(self._known[name].get)


def run(rows: DataFrame, write: Callable[[DataFrame], None], **sums: Column) -> dict:
    """Writes the rows and gives the aggregates of what was written."""
    metrics = Metrics()
    write(metrics.watch(rows, "run", **sums))
    return metrics.of("run")


def usage(rows: DataFrame, sent: str, received: str, write: Callable[[DataFrame], None]) -> dict:
    """``calls``, ``sent`` and ``received`` tokens of a table of replies, counted while it is written; missing counts
    are none."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return run(rows, write, calls=F.count("*"), sent=count(sent), received=count(received))
