"""Append with resume: rows that arrive again, or arrive after a restart, are done once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def still_to_do(rows: DataFrame, done: DataFrame, key: str, keep_failed: bool = False, error: str = "error") -> DataFrame:
    """Rows whose key isn't in ``done``. Rows of ``done`` with an error count as not done, unless ``keep_failed``."""
    finished = done if keep_failed else done.where(F.coalesce(error, F.lit("")) == "")
    return rows.join(finished.select(key), key, "left_anti")


def latest(done: DataFrame, key: str, error: str = "error") -> DataFrame:
    """What was written by ``append_once`` without superseded rows: of each key the last that went well, else the last that failed."""
    well = F.coalesce(error, F.lit("")) == ""
    rows = done.groupBy(key).agg(F.max_by(F.struct(*[c for c in done.columns if c != key]), F.struct(well.alias("w"), F.col("batch").alias("b"))).alias("_r"))
    return rows.select(key, "_r.*").select(*done.columns)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What is at ``path``, or nothing yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def append_once(make: Callable[[DataFrame], DataFrame], path: str, key: str, keep_failed: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the batch's new keys go through ``make`` and are appended to ``path`` once.

    A batch is written under its own number, replacing what a failed attempt left, so a repeated batch adds nothing. A
    key that comes several times in a batch is done once (any of its rows); null keys are left out. ``make`` must keep
    ``key`` and give an ``error`` column, empty where all went well.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        like = make(new.limit(0)).withColumn("batch", F.lit(0).cast("bigint"))
        before = _read(spark, path, like).where(F.col("batch") != number)
        make(still_to_do(new, before, key, keep_failed)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return run


def resume(source: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str, keep_failed: bool = False) -> StreamingQuery:
    """Run all that a streaming ``source`` has now through ``append_once`` and stop; called again, it goes on from there."""
    return source.writeStream.foreachBatch(append_once(make, path, key, keep_failed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

