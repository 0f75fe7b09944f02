"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alinea.plans.stage import staged

#: Rows of one key beyond which the key is spread over several tasks.
HOT_ROWS = 250_000
#: A hot-key list is broadcast up to this many rows and bytes of its files; beyond them, it is joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """Keys with more than ``hot_rows`` rows and the number of slices each needs, counted with map-side combining.

    There are at most rows / hot_rows of them. Returns the staged list and its length.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = staged(counted.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices")), "hot")
    return hot, hot.count()


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a staged table, with a broadcast hint if its counted rows and its files' size are small, else with that of a shuffle join.

    Without the second hint, Spark broadcasts a table of many rows whose compressed files are small.
    """
    return F.broadcast(df) if is_small(df, rows) else df.hint("merge")


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df``, a staged table, may be broadcast: its counted rows and its files' size are within the bounds."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, also: Column | None = None, hot_rows: int = HOT_ROWS, hot: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``keys`` (same names on both sides), hot keys of ``left`` salted.

    Rows of a hot key are dealt over slices by a hash of all their columns (a recomputed task deals them alike) and the
    matching rows of ``right`` repeated once per slice; other keys are joined as they are. Rows that are alike in every
    column share a slice: a caller that may have many such copies counts them first. ``also`` is a further condition over columns whose names differ between the sides.
    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing. Key columns come from ``left``. ``hot`` is what
    ``hot_keys`` gave for ``left`` or a table that contains it, where several joins share it; else it is counted here.
    """
    assert how in ("inner", "left", "left_semi", "left_anti"), how
    hot, n = hot or hot_keys(left, keys, hot_rows)
    sliced = bool(n)
    if sliced:
        few = checked_broadcast(hot, n)
        deal = F.xxhash64(*left.columns)
        left = left.join(few, keys, "left").withColumn("_slice", F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(deal, F.col("_slices"))).cast("int")).drop("_slices")
        right = right.join(few, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))).drop("_slices")
    on = [*keys, *["_slice"] * sliced]
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = also
    for k in on:
        same = left[k] == right[f"_r_{k}"]
        cond = same if cond is None else cond & same
    out = left.join(right, cond, how)
    return out.drop("_slice", *[f"_r_{k}" for k in on])
