"""Problem 1: samples whose category shares match given targets, with floors, and a report of what can't be met.

Every target set gets its own sample. Its targets are grouped by what they restrict (band, source, both); the targets of a
group are disjoint, and rows outside of all of them share what the group's shares leave of 1, or are left out if
that is nothing. Totals are the shares of ``sample_rows``, lifted to the floors, as far as there are rows for them;
inclusion probabilities come from the tilting dual over counted cells (``calibration``). Rows of one combination of
targets have the same probability. The pivotal method rounds the combinations' expected sizes to whole ones; where that
would miss a floor, it is put right. It then draws exactly that many rows of each combination: in chunks of one
combination, then among the chunks' undecided rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.functions.keys import norm_category
from alinea.llm.calibration import floored_totals, tilt
from alinea.plans.stage import drop, staged
from alinea.plans.unions import union_all
from alinea.sources.tables import table

#: Rows of one combination that one task draws from.
CHUNK_ROWS = 50_000
#: Target rows that are read on the driver at most; more raise ValueError.
MAX_TARGETS = 10_000


class Target(NamedTuple):
    target_set: str
    band: str
    source: str
    share: float
    min_rows: int
    sample_rows: int
    band_key: str | None  # null: any
    source_key: str | None

    def takes(self, band: str | None, source: str | None) -> bool:
        return self.band_key in (None, band) and self.source_key in (None, source)

    @property
    def required(self) -> float:
        return max(float(self.min_rows), self.share * self.sample_rows)


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets, a settings table, on the driver. Null shares, floors and sizes count as 0; ``*`` or null is any category."""
    def key(c: str):
        return F.when(F.trim(c) != "*", norm_category(c)).alias(f"{c}_key")

    rows = targets.select("target_set", "band", "source", F.coalesce("share", F.lit(0.0)), F.coalesce("min_rows", F.lit(0)), F.coalesce("sample_rows", F.lit(0)), key("band"), key("source")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return [Target(*r) for r in rows]


def categorised(df: DataFrame, targets: list[Target], item: str, band: str, source: str, latest: str | None = None) -> DataFrame:
    """One row an item: ``item``, its ``band`` and ``source`` keys, and ``seen``, all pairs of keys that its rows have.

    Values that no target names become null. Of several rows the one highest by ``latest`` (then by keys) gives the
    item's own categories. Rows without an item are left out. Repeated rows are combined before the shuffle.
    """
    def known(c: str, keys: set[str]):
        v = norm_category(c)
        return F.when(v.isin(sorted(keys)), v) if keys else F.lit(None).cast("string")

    bands, sources = ({getattr(t, f) for t in targets} - {None} for f in ("band_key", "source_key"))
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), known(band, bands).alias("band"), known(source, sources).alias("source"), (F.col(latest) if latest else F.lit(0)).alias("at"))
    best = F.max(F.struct("at", "band", "source")).alias("best")
    return rows.groupBy("item").agg(best, F.collect_set(F.struct("band", "source")).alias("seen")).select("item", "best.band", "best.source", "seen")


def counted_cells(items: DataFrame) -> DataFrame:
    """``band, source, seen, n``: items alike in all that targets can tell apart. One row for each such kind, combined map-side."""
    return items.groupBy("band", "source", F.array_sort("seen").alias("seen")).agg(F.count(F.lit(1)).alias("n"))


def available(cells: DataFrame, targets: list[Target]) -> list[int]:
    """For each target, how many items have a row that it takes: the kinds of items meet the targets by what these restrict."""
    if not targets:
        return []
    spark = cells.sparkSession
    listed = spark.createDataFrame([(k, t.band_key, t.source_key) for k, t in enumerate(targets)], "k int, t_band string, t_source string")
    kinds = cells.groupBy("seen").agg(F.sum("n").alias("n"))
    pairs = kinds.select("seen", "n", F.explode("seen").alias("s"))
    band, source = F.col("s.band") == F.col("t_band"), F.col("s.source") == F.col("t_source")
    shapes = [("t_band is not null and t_source is not null", band & source), ("t_band is not null and t_source is null", band), ("t_band is null and t_source is not null", source)]
    met = [pairs.join(F.broadcast(listed.where(w)), on).select("seen", "n", "k") for w, on in shapes]  # at most MAX_TARGETS rows
    met.append(kinds.crossJoin(F.broadcast(listed.where("t_band is null and t_source is null"))).select("seen", "n", "k"))  # one row for each set at most
    each = union_all(met).distinct().groupBy("k").agg(F.sum("n").alias("n"))
    found = {r.k: r.n for r in each.collect()}  # a row for each target
    return [found.get(k, 0) for k in range(len(targets))]


Cell = tuple[str | None, str | None]


class Plan(NamedTuple):
    """Of one target set: each target's total and sampled rows, whether all totals are met, each cell's combination of
    targets, and how many rows of each combination are drawn."""

    aimed: dict[int, float]
    sampled: dict[int, int]
    converged: bool
    marks: dict[Cell, str]
    draws: dict[str, int]


def plan(targets: list[Target], counts: dict[Cell, int], seed: int = 17) -> Plan:
    """Totals, probabilities and whole sizes of one target set, from the counted cells."""
    size = max(t.sample_rows for t in targets)
    cells = list(counts)
    rows = np.array([counts[c] for c in cells], float)
    columns, goals, aimed, out = [], [], {}, np.zeros(len(cells), bool)
    takes = np.array([[t.takes(*c) for t in targets] for c in cells], bool).reshape(len(cells), len(targets))
    floors = np.minimum([t.min_rows for t in targets], rows @ takes) if len(cells) else np.zeros(len(targets))
    for shape in sorted({(t.band_key is None, t.source_key is None) for t in targets}):
        group = [k for k, t in enumerate(targets) if (t.band_key is None, t.source_key is None) == shape]
        goal = floored_totals(np.array([targets[k].share for k in group]), floors[group], size)
        for k, g in zip(group, goal):
            aimed[k] = float(g)
            columns.append(takes[:, k])
            goals.append(g)
        outside, rest = ~takes[:, group].any(axis=1), size - goal.sum()
        if rest < 0.01:
            out |= outside
        else:
            columns.append(outside)
            goals.append(rest)
    x = np.array(columns, float).T.reshape(len(cells), len(columns))
    x[out] = 0
    p, converged = tilt(np.where(out, 0, rows), x, np.array(goals, float))
    marks = {c: "".join("01"[int(b)] for b in takes[i]) for i, c in enumerate(cells)}
    room, wanted = dict.fromkeys(marks.values(), 0), dict.fromkeys(marks.values(), 0.0)
    for i, c in enumerate(cells):
        room[marks[c]] += counts[c]
        wanted[marks[c]] += float(p[i] * rows[i])
    draws = whole_sizes(wanted, room, {k: int(f) for k, f in enumerate(floors) if f > 0}, random.Random(f"{seed}|{targets[0].target_set}"))
    sampled = {k: sum(n for m, n in draws.items() if m[k] == "1") for k in range(len(targets))}
    return Plan(aimed, sampled, converged, marks, draws)


def whole_sizes(wanted: dict[str, float], room: dict[str, int], floors: dict[int, int], rng: random.Random) -> dict[str, int]:
    """How many rows of each combination to draw: ``wanted`` rounded up or down by the pivotal method, then floors put right.

    A combination names its targets by 1s. While a target has fewer rows than its floor, a combination of it that has
    room gets one more, and, if the sample would grow, one above its wanted size loses one, if no floor needs it.
    ``floors`` must not exceed their targets' rows; they then hold exactly.
    """
    names = sorted(wanted)
    taken, held = pivotal(((m, wanted[m] - int(wanted[m] + 1e-9)) for m in names), rng)
    if held is not None and rng.random() < held[1]:
        taken.append(held[0])
    n = {m: min(room[m], int(wanted[m] + 1e-9) + (m in set(taken))) for m in names}
    total = sum(n.values())

    def lacking() -> dict[int, int]:
        short = {k: f - sum(v for m, v in n.items() if m[k] == "1") for k, f in floors.items()}
        return {k: v for k, v in short.items() if v > 0}

    while short := lacking():
        helps = {m: sum(m[k] == "1" for k in short) for m in names if n[m] < room[m]}
        more = max((m for m in helps if helps[m]), key=lambda m: (helps[m], wanted[m] - n[m], m))
        n[more] += 1
        if sum(n.values()) > total:
            spare = [m for m in names if m != more and n[m] > 0 and all(m[k] == "0" or sum(v for o, v in n.items() if o[k] == "1") > f for k, f in floors.items())]
            spare = [m for m in spare if n[m] > wanted[m] - 1]
            if spare:
                n[max(spare, key=lambda m: (n[m] - wanted[m], m))] -= 1
            else:
                total += 1
    return n


def pivotal(units: Iterable[tuple[object, float]], rng: random.Random) -> tuple[list[object], tuple[object, float] | None]:
    """Decide units of given probabilities by duels in order: the units taken, and the one left undecided, if any.

    In a duel one of the two is decided and the other keeps the pair's remaining probability, so the sum of the
    probabilities is kept and every unit is taken with its own.
    """
    taken, held = [], None
    for u, p in units:
        if p <= 1e-9 or p >= 1 - 1e-9:
            if p >= 0.5:
                taken.append(u)
        elif held is None:
            held = (u, p)
        else:
            v, q = held
            s = p + q
            if s <= 1:
                winner = u if rng.random() * s < p else v
                held = (winner, s)
            else:
                # one of them is taken, the other keeps what is above 1
                first_stays = rng.random() * (2 - s) < 1 - q  # then v keeps s - 1 and u is taken
                taken.append(u if first_stays else v)
                held = (v if first_stays else u, s - 1)
            if held[1] >= 1 - 1e-9:
                taken.append(held[0])
                held = None
            elif held[1] <= 1e-9:
                held = None
    return taken, held


def _drawn(by: list[str], seed: int, last: bool):
    """The pivotal method over one group of rows, in an order of their own hash; the probabilities of a last group add up to a whole number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "item"], kind="stable").reset_index(drop=True)
        rng = random.Random("|".join([str(seed), *(str(pdf[c].iloc[0]) for c in by)]))
        taken, held = pivotal(zip(range(len(pdf)), pdf["left"]), rng)
        if held is not None and last and held[1] >= 0.5:
            taken.append(held[0])
        pdf["drawn"] = False
        pdf.loc[taken, "drawn"] = True
        if held is not None and not last:
            pdf.loc[held[0], "left"] = held[1]
            taken.append(held[0])
        return pdf.loc[taken]

    return run


def _draw(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (target_set, item, mark, chunk, probability) that the pivotal method takes."""
    state = rows.withColumn("left", F.col("probability")).withColumn("turn", F.xxhash64("item", F.lit(seed))).withColumn("drawn", F.col("left") >= 1)
    done, open_ = [state.where("drawn")], state.where("not drawn and left > 0")
    for by in (["target_set", "mark", "chunk"], ["target_set", "mark"]):
        step = staged(open_.groupBy(*by).applyInPandas(_drawn(by, seed, len(by) == 2), state.schema), "drawn")
        done.append(step.where("drawn"))
        open_ = step.where("not drawn")
    return union_all(done).select("target_set", "item", "mark", "probability")


class Calibration(NamedTuple):
    """What is known before anything is drawn: targets, items, counts of cells, what is there for each target, and each set's plan."""

    targets: list[Target]
    items: DataFrame
    counts: dict[Cell, int]
    there: list[int]
    plans: dict[str, Plan]


def calibrate(df: DataFrame, targets: DataFrame, item: str, band: str = "band", source: str = "source", latest: str | None = None, seed: int = 17) -> Calibration:
    """Counts the cells of ``df`` in one distributed aggregation and plans every target set's sample from them."""
    goals = read_targets(targets)
    items = categorised(df, goals, item, band, source, latest)
    cells = staged(counted_cells(items), "cells")
    counted = cells.groupBy("band", "source").agg(F.sum("n").alias("n")).collect()  # at most (bands + 1) * (sources + 1) rows
    counts = {(r.band, r.source): r.n for r in counted}
    plans = {s: plan([t for t in goals if t.target_set == s], counts, seed) for s in dict.fromkeys(t.target_set for t in goals)}
    there = available(cells, goals)
    drop(cells)
    return Calibration(goals, items, counts, there, plans)


def sample_report(spark: SparkSession, c: Calibration) -> DataFrame:
    """One row a target: its columns, ``required`` (the larger of its floor and its share of the sample), ``available``
    (distinct items with a row of it), ``aimed`` (its total after floors), ``sampled`` (what is drawn of it), ``off``
    (``sampled`` less ``aimed``), ``converged`` (false if the set's totals contradict each other) and ``gap`` (fewer are
    available than required)."""
    lines, place = [], {}
    for t, there in zip(c.targets, c.there):
        k = place[t.target_set] = place.get(t.target_set, -1) + 1
        of = c.plans[t.target_set]
        lines.append((*t[:6], t.required, there, round(of.aimed[k], 6), of.sampled[k], round(of.sampled[k] - of.aimed[k], 6), of.converged, there < t.required))
    return spark.createDataFrame(lines, "target_set string, band string, source string, share double, min_rows int, sample_rows int, required double, available bigint, aimed double, sampled bigint, off double, converged boolean, gap boolean")


def draw(c: Calibration, item: str, seed: int = 17) -> DataFrame:
    """The samples that ``c`` plans: ``target_set, item, band, source, probability``, categories by their keys."""
    items = staged(c.items, "items")
    sizes: dict[tuple[str, str], int] = {}
    for s, x in c.plans.items():
        for cell, m in x.marks.items():
            sizes[s, m] = sizes.get((s, m), 0) + c.counts[cell]
    cells = [(s, *cell, m, x.draws[m] / sizes[s, m], -(-sizes[s, m] // CHUNK_ROWS)) for s, x in c.plans.items() for cell, m in x.marks.items() if x.draws[m]]
    cell_rows = items.sparkSession.createDataFrame(cells, "target_set string, c_band string, c_source string, mark string, probability double, chunks int")
    met = items.select("item", "band", "source").join(F.broadcast(cell_rows), F.col("band").eqNullSafe(F.col("c_band")) & F.col("source").eqNullSafe(F.col("c_source")))
    rows = met.select("target_set", F.col("item").cast("string").alias("item"), "mark", F.pmod(F.xxhash64("item", F.lit(seed + 1)), F.col("chunks")).alias("chunk"), "probability")
    own = items.select(F.col("item").alias(item), F.col("item").cast("string").alias("_item"), "band", "source")
    return own.join(_draw(rows, seed).withColumnRenamed("item", "_item"), "_item").select("target_set", item, "band", "source", "probability")


def matched_samples(df: DataFrame, targets: DataFrame, item: str, band: str = "band", source: str = "source", latest: str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Samples (``draw``) and report (``sample_report``) for every target set; an item comes at most once a set.

    Floors hold exactly as far as there are rows for them. Without targets or items the samples are empty; without
    targets the report is, too.
    """
    c = calibrate(df, targets, item, band, source, latest, seed)
    return draw(c, item, seed), sample_report(df.sparkSession, c)


def _of_review(spark: SparkSession, d: str) -> Calibration:
    return calibrate(table(spark, d, "review"), table(spark, d, "sample_targets"), "review_id", latest="received_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that too few reviewed items are there for."""
    return p1_report(spark, d).where("gap").select("target_set", "band", "source")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """All targets with what is required, available, aimed at and sampled."""
    return sample_report(spark, _of_review(spark, d))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that is counted, which SQL can express too."""
    return p1_report(spark, d).select("target_set", "band", "source", "required", "available", "gap")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled items of every target set."""
    return draw(_of_review(spark, d), "review_id")


P1_SQL = r"""
WITH r AS (SELECT review_id, lower(regexp_replace(band, '[\s_-]+', '', 'g')) AS b, lower(regexp_replace(source, '[\s_-]+', '', 'g')) AS s FROM review),
t AS (SELECT *, lower(regexp_replace(band, '[\s_-]+', '', 'g')) AS b, lower(regexp_replace(source, '[\s_-]+', '', 'g')) AS s FROM sample_targets)
SELECT target_set, band, source FROM t
WHERE (SELECT count(DISTINCT review_id) FROM r WHERE (t.b = '*' OR r.b = t.b) AND (t.s = '*' OR r.s = t.s)) < greatest(min_rows, share * sample_rows)
"""


P1_COUNTS_SQL = P1_SQL[: P1_SQL.index("SELECT target_set")] + """
, c AS (SELECT target_set, band, source, greatest(CAST(min_rows AS DOUBLE), share * sample_rows) AS required,
  (SELECT count(DISTINCT review_id) FROM r WHERE (t.b = '*' OR r.b = t.b) AND (t.s = '*' OR r.s = t.s)) AS available FROM t)
SELECT *, available < required AS gap FROM c
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_counts": p1_counts, "p1_report": p1_report, "p1_sample": p1_sample}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_counts": P1_COUNTS_SQL}
