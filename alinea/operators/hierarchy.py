"""Trees kept as rows with a parent key: closure, inheritance, roll-up."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from alinea.plans.stage import drop, staged
from alinea.plans.unions import union_all


def ancestors(df: DataFrame, key: str, parent: str, most: int = 64) -> DataFrame:
    """``node, ancestor, distance`` (1 for the parent) along parents that are rows of ``df``.

    One self-join a level, until no row has a further ancestor; each level is staged. Null parents and parents that
    are no rows end a chain; a chain longer than ``most`` (a cycle) raises ValueError. Keys must be unique.
    """
    edges = staged(df.select(F.col(key).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null"), "edges")
    rows = df.select(F.col(key).alias("ancestor"))
    level = staged(edges.join(rows, "ancestor", "left_semi").select("node", "ancestor", F.lit(1).alias("distance")), "level")
    levels = [level]
    up = edges.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    while not level.isEmpty():
        if len(levels) > most:
            raise ValueError(f"a chain of more than {most} parents")
        step = level.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        level = staged(step.join(rows, "ancestor", "left_semi").select("node", "ancestor", "distance"), "level")
        levels.append(level)
    drop(edges)
    return union_all(levels)


def children(df: DataFrame, key: str, parent: str, order: Column) -> DataFrame:
    """``key, n_children, child_ids`` in ``order`` for every row; an empty list for leaves."""
    kids = df.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(key).alias("k")))).alias("kids"))
    out = df.select(key).join(kids, key, "left")
    ids = F.coalesce(F.transform("kids", lambda x: x["k"]), F.array().cast("array<string>"))
    return out.select(key, F.size(ids).alias("n_children"), ids.alias("child_ids"))


def inherit(df: DataFrame, closure: DataFrame, key: str, value: str) -> DataFrame:
    """``key, own, value, inherited``: the nearest value up the chain, the row's own first.

    ``inherited`` is true if the row has none of its own but a parent, even if no ancestor has one either.
    """
    above = closure.withColumnRenamed("node", key).join(df.select(F.col(key).alias("ancestor"), F.col(value).alias("v")), "ancestor")
    nearest = above.groupBy(key).agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("distance"))).alias("v"))
    out = df.select(key, F.col(value).alias("own")).join(nearest.withColumn("has_parent", F.lit(True)), key, "left")
    return out.select(key, "own", F.coalesce("own", "v").alias(value), (F.col("own").isNull() & F.coalesce("has_parent", F.lit(False))).alias("inherited"))


def roll_up(df: DataFrame, closure: DataFrame, key: str, text: str, order: Column) -> DataFrame:
    """``key, full_text``: a row's text and its descendants' in ``order`` (parents before children), by blanks.

    A subtree's texts come together in one row, as they do in the result.
    """
    texts = df.select(F.col(key).alias("node"), F.col(text).alias("t"), order.alias("o"))
    below = union_all([closure.select("node", F.col("ancestor").alias(key)), df.select(F.col(key).alias("node"), key)]).join(texts, "node")
    return below.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "node", "t"))), lambda x: x["t"]), " ").alias("full_text"))


def chain_text(df: DataFrame, closure: DataFrame, key: str, text: str) -> DataFrame:
    """``key, chain``: the ancestors' texts from the root down, by blanks; no row without ancestors."""
    above = closure.withColumnRenamed("node", key).join(df.select(F.col(key).alias("ancestor"), F.col(text).alias("t")), "ancestor")
    return above.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "t"))), lambda x: x["t"]), " ").alias("chain"))


def path_order(path: Column | str) -> Column:
    """A dotted path of numbers and letters as a string that sorts parents first and 10 behind 9."""
    return F.array_join(F.transform(F.split(path, r"\."), lambda m: F.when(m.rlike("^[0-9]+$"), F.lpad(m, 6, "0")).otherwise(m)), ".")
