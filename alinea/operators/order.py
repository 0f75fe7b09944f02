"""Places in a total order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alinea.plans.stage import staged


def places(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with its place (from 1) in ``order``, which should have no ties.

    Rows are sorted by ranges; a row's place is its place in its range and the rows of the ranges before. These counts,
    one for each partition of the sort, are added up on the driver.
    """
    rows = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each partition
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r.n
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    met = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row for each partition
    return met.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")
