"""Current versions of rows that are sent again, withdrawn or retired."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def current(df: DataFrame, key: str, loaded: str, ended: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The last loaded row of each key, if it still holds. Null keys are left out. One shuffle, combined map-side.

    Whole rows go through the aggregation, so name the ``columns`` that are wanted (all, if none): others aren't read.
    """
    if columns:
        df = df.select(*dict.fromkeys([key, loaded, ended, *columns]))
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(loaded)).alias("r"))
    return last.select("r.*").where(F.col(ended).isNull())
