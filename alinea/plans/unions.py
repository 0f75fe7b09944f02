"""Unions whose rows may be grouped, joined or ranked."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of all ``frames``, columns matched by name.

    Spark 4.1 takes a union of inputs that are hash-partitioned alike for partitioned alike itself, even where adaptive
    execution reads their partitions in different ranges; rows of one group then stay apart without an error. That
    shortcut is turned off for the session here; other versions don't have it.
    """
    frames = list(frames)
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)
