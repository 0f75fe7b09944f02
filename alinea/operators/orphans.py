"""References to records that do not exist, found by a cascade down the foreign-key graph.

Tables in:

- references: ``src_table, src_field, record_id, ref_table, ref_key, at``, and, where the referring record can itself be
  referred to (as ``src_table``), ``own_key, own_from, own_to``: its key and the span in which this version of it holds,
  else nulls. Null ``ref_key`` refers to nothing and is no reference.
- targets: ``ref_table, key, valid_from, valid_to``: the spans in which a key holds; ``valid_to`` null means still, a
  null ``valid_from`` covers nothing.

A reference is a *direct* orphan if no span of its key covers its time: ``valid_from <= at`` and (``valid_to`` null or
``> at``); with a null ``at`` no span covers it. It is an *inherited* orphan if it isn't direct, and a version of the
record that it refers to, one that holds at its time, is an orphan, be it direct or inherited. A version is an orphan if
one of its references is; other versions of the same key aren't touched by that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alinea.plans.skew import hot_keys, skew_join
from alinea.plans.stage import drop, staged
from alinea.plans.unions import union_all

REFERENCE = ["src_table", "src_field", "record_id", "ref_table", "ref_key", "at", "own_key", "own_from", "own_to"]
KEY = ["ref_table", "ref_key"]


def _held() -> Column:
    return (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))


def _distinct(references: DataFrame) -> DataFrame:
    return references.select(*REFERENCE).where(F.col("ref_key").isNotNull()).distinct()


def _unheld(refs: DataFrame, targets: DataFrame, hot_rows: int, hot: tuple[DataFrame, int] | None = None) -> DataFrame:
    spans = targets.where(F.col("key").isNotNull()).select("ref_table", F.col("key").alias("ref_key"), "valid_from", "valid_to").distinct()
    return skew_join(refs, spans, KEY, "left_anti", _held(), hot_rows, hot)


def direct_orphans(references: DataFrame, targets: DataFrame, hot_rows: int = 250_000) -> DataFrame:
    """References whose key had no valid row at their time: an anti join on key and span, hot keys salted.

    Repeated references are reduced to one before the join. Columns of ``references`` beyond ``REFERENCE`` are dropped.
    """
    return _unheld(_distinct(references), targets, hot_rows)


def orphans(references: DataFrame, targets: DataFrame, hot_rows: int = 250_000) -> DataFrame:
    """All orphan references: the columns of a reference, ``kind`` (direct, inherited) and ``depth`` (0 for direct ones).

    Fixpoint: the versions with a direct orphan form the first frontier; each round takes, by a semi join on key and
    span, the references between records to versions of the frontier, and their owners that weren't there before form
    the next, until none is left; so cycles end. Every frontier is a staged table. References of records that nothing
    can refer to (most of them) take no part in the rounds: at the end all references meet all orphan versions once.
    """
    refs = staged(_distinct(references), "refs")
    hot = hot_keys(refs, KEY, hot_rows)
    direct = staged(_unheld(refs, targets, hot_rows, hot).select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth")), "orphans")
    between = refs.where("own_key is not null")

    def owners(found: DataFrame) -> DataFrame:
        return found.where("own_key is not null").select(F.col("src_table").alias("ref_table"), F.col("own_key").alias("ref_key"), F.col("own_from").alias("valid_from"), F.col("own_to").alias("valid_to")).distinct()

    frontier, nodes = staged(owners(direct), "frontier"), []
    while not frontier.isEmpty():
        nodes.append(frontier.withColumn("depth", F.lit(len(nodes) + 1)))
        reached = skew_join(between, frontier, KEY, "left_semi", _held(), hot_rows, hot)
        known = union_all(nodes).drop("depth").alias("k")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("ref_table", "ref_key", "valid_from", "valid_to")]
        frontier = staged(owners(reached).alias("n").join(known, reduce(lambda a, b: a & b, same), "left_anti"), "frontier")
    if not nodes:
        drop(refs, frontier, hot[0])
        return direct
    # A reference may meet several versions: it is kept once, at its least depth. Direct orphans meet none.
    met = skew_join(refs, union_all(nodes), KEY, "inner", _held(), hot_rows, hot).groupBy(*REFERENCE).agg(F.min("depth").alias("depth"))
    inherited = staged(met.select(*REFERENCE, F.lit("inherited").alias("kind"), "depth"), "orphans")
    drop(refs, frontier, hot[0], *nodes)
    return union_all([direct, inherited])


def with_reason(found: DataFrame, targets: DataFrame, hot_rows: int = 250_000) -> DataFrame:
    """``found`` with ``reason``: for direct orphans ``never there`` (no row has the key), ``not yet there`` (its first
    span begins later), ``ended``, or ``no time``; ``inherited`` for the others."""
    first = targets.where(F.col("key").isNotNull()).groupBy("ref_table", F.col("key").alias("ref_key")).agg(F.min("valid_from").alias("first_from"), F.lit(True).alias("known"))
    at = F.col("at")
    reason = (
        F.when(F.col("kind") == "inherited", "inherited")
        .when(F.col("known").isNull(), "never there")
        .when(at.isNull(), "no time")
        .when(F.col("first_from") <= at, "ended")
        .otherwise("not yet there")
    )
    return skew_join(found, first, KEY, "left", None, hot_rows).withColumn("reason", reason).drop("first_from", "known")


def orphan_report(found: DataFrame) -> DataFrame:
    """Per referring table, field and month of the reference: ``n_direct``, ``n_inherited``, the direct ones by reason
    (``n_never_there, n_ended, n_not_yet_there``; those without a time count in none) and ``n_records``, the distinct
    referring records (by ``record_id``, else by ``own_key``). ``found`` comes from ``with_reason``."""
    return found.groupBy("src_table", "src_field", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count_if(F.col("kind") == "direct").alias("n_direct"),
        F.count_if(F.col("kind") == "inherited").alias("n_inherited"),
        *[F.count_if(F.col("reason") == r).alias("n_" + r.replace(" ", "_")) for r in ("never there", "ended", "not yet there")],
        F.count_distinct(F.coalesce(F.col("record_id").cast("string"), "own_key")).alias("n_records"),
    )
