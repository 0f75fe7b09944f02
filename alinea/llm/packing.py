"""Problem 7: texts put into containers of fixed capacity, by a grouping genetic algorithm on islands.

Items are dealt at random into sets of about ``set_items``, so that each has the sizes of the whole. Each set begins with
the better of two constructions (looking ahead, and best fit decreasing). Sets in which that needs more containers than
a proven lower bound evolve: ``islands`` populations each, a row each, and between epochs every island's elite moves on to
the next island by a shuffle; a set whose bound is met takes part no longer. Then every set's containers that aren't full
(the emptiest, at most a quarter of all) are dissolved, the items of several sets are brought together in one, and all
begins anew with these, until the sum over the sets meets the bound of the whole or one set is left: so what sets waste
at their ends doesn't add up. No task holds more than one set; sets and populations are rows of staged tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.llm.encoding import count_column
from alinea.llm.grouping import best_fit, evolve, least_bins, least_slack
from alinea.plans.stage import drop, staged
from alinea.plans.unions import union_all
from alinea.sources.tables import table

#: Capacities that are read on the driver at most; more raise ValueError.
MAX_LIMITS = 1000
_SET = ["limit_name", "set_no"]
_BINS = "array<array<int>>"


class Capacity(NamedTuple):
    name: str
    max_tokens: int
    tokenizer: str = "byte_bpe_50k.json"


class Search(NamedTuple):
    """Sizes of the search: items of a set, islands of a set that doesn't meet its bound, epochs between which elites
    migrate, generations of an epoch, and members of a population."""

    set_items: int = 1000
    islands: int = 4
    epochs: int = 4
    generations: int = 40
    members: int = 8


class Packed(NamedTuple):
    """``parts`` (see ``pack``) and, for each capacity, ``limit_name, capacity, n_full`` (parts that fill a container each), ``n_loose``
    tokens of the others, and ``n_fit``, the containers that best fit decreasing needs for the sets dealt first."""

    parts: DataFrame
    start: DataFrame


def _rows(make: Callable[[dict], dict], schema: pa.Schema):
    """``make`` for each row of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([make(r) for r in batch.to_pylist()], schema=schema)

    return run


_KEY = [("limit_name", pa.string()), ("set_no", pa.int64())]
_LISTS = pa.list_(pa.list_(pa.int32()))


def _begun(r: dict) -> dict:
    sizes, capacity = r["sizes"], r["capacity"]
    fit = best_fit(sizes, capacity, [], sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    best = min(least_slack(sizes, capacity), fit, key=len)
    return {**r, "bins": best, "n_bins": len(best), "bound": least_bins(sizes, capacity), "n_fit": len(fit)}


def _evolved(search: Search, epoch: int) -> Callable[[dict], dict]:
    def make(r: dict) -> dict:
        seed = (r["set_no"] * search.islands + r["island"]) * 1000 + epoch
        migrants = [[tuple(b) for b in r["migrant"]]] if r["migrant"] else []
        members = [[tuple(b) for b in m] for m in r["population"] or []]
        grown = evolve(r["sizes"], r["capacity"], members, migrants, seed, search.members, search.generations)
        return {**r, "population": grown, "n_bins": len(grown[0])}

    return make


def _evolve_sets(open_: DataFrame, search: Search, tasks: int, label: str) -> DataFrame:
    """``limit_name, set_no, bins`` of sets (limit_name, capacity, set_no, sizes, bound) that their start didn't bring to the bound."""
    columns = [*_SET, "capacity", "sizes", "bound", "island"]
    schema = pa.schema([*_KEY, ("capacity", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bound", pa.int32()), ("island", pa.int32()), ("population", pa.list_(_LISTS)), ("migrant", _LISTS), ("n_bins", pa.int32())])
    spec = f"limit_name string, set_no bigint, capacity int, sizes array<int>, bound int, island int, population array<{_BINS}>, migrant {_BINS}, n_bins int"
    state = open_.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(search.islands - 1)))).select(*columns, F.lit(None).cast(f"array<{_BINS}>").alias("population"), F.lit(None).cast(_BINS).alias("migrant"))
    done = []
    for epoch in range(search.epochs):
        if epoch:
            elite = state.select(*_SET, ((F.col("island") + 1) % search.islands).alias("island"), F.col("population")[0].alias("migrant"))
            state = state.select(*columns, "population").join(elite, [*_SET, "island"])
        even = state.select(*columns, "population", "migrant").repartition(tasks, *_SET, "island")
        grown = staged(even.mapInArrow(_rows(_evolved(search, epoch), schema), spec), f"{label}-islands")
        best = staged(grown.groupBy(*_SET).agg(F.min_by(F.col("population")[0], F.struct("n_bins", "island")).alias("bins"), (F.min("n_bins") <= F.first("bound")).alias("met")), f"{label}-best")
        last = epoch == search.epochs - 1
        done.append((best if last else best.where("met")).select(*_SET, "bins"))
        if last or best.where("not met").isEmpty():
            break
        state = grown.join(best.where("met"), _SET, "left_anti")
    return union_all(done)


def _pack_sets(items: DataFrame, search: Search, tasks: int, label: str) -> tuple[DataFrame, DataFrame]:
    """``items`` (limit_name, capacity, set_no, uid, part_no, size) with ``bin``, their container in the set, and the sets' ``n_fit``."""
    sets = staged(items.groupBy("limit_name", "capacity", "set_no").agg(F.array_sort(F.collect_list(F.struct("uid", "part_no", "size"))).alias("items")), f"{label}-sets")
    shape = pa.schema([*_KEY, ("capacity", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bins", _LISTS), ("n_bins", pa.int32()), ("bound", pa.int32()), ("n_fit", pa.int32())])
    plain = sets.select(*_SET, "capacity", F.col("items.size").alias("sizes")).repartition(tasks, *_SET)
    begun = staged(plain.mapInArrow(_rows(_begun, shape), f"limit_name string, set_no bigint, capacity int, sizes array<int>, bins {_BINS}, n_bins int, bound int, n_fit int"), f"{label}-begun")
    bins = begun.select(*_SET, "bins")
    open_ = begun.where("n_bins > bound")
    if not open_.isEmpty():
        bins = union_all([begun.where("n_bins <= bound").select(*_SET, "bins"), _evolve_sets(open_, search, tasks, label)])
    placed = bins.select(*_SET, F.posexplode("bins").alias("bin", "members")).select(*_SET, "bin", F.explode("members").alias("at"))
    each = sets.select("limit_name", "capacity", "set_no", F.posexplode("items").alias("at", "item"))
    out = staged(each.join(placed, [*_SET, "at"]).select("limit_name", "capacity", "set_no", "bin", "item.*"), f"{label}-packed")
    drop(sets)
    return out, begun.select("limit_name", "n_fit")


def packed(df: DataFrame, key: str, text: str, capacities: list[Capacity], folder: str | None = None, search: Search = Search()) -> Packed:
    """``pack`` with what it began from."""
    if any(c.max_tokens < 1 for c in capacities):
        raise ValueError("capacities must be positive")
    if len({c.name for c in capacities}) < len(capacities):
        raise ValueError("names of capacities must differ")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = []
    for t in dict.fromkeys(c.tokenizer for c in capacities):
        limits = F.array(*[F.struct(F.lit(c.name).alias("limit_name"), F.lit(c.max_tokens).cast("int").alias("capacity")) for c in capacities if c.tokenizer == t])
        sizes = staged(count_column(rows, "key", "text", t, folder).withColumn("uid", F.monotonically_increasing_id()), "sizes")
        counted.append(sizes.select("key", "uid", "n_tokens", F.explode(limits).alias("limit")).select("key", "uid", "n_tokens", "limit.*"))
    each = union_all(counted) if counted else rows.select("key", F.lit(0).cast("bigint").alias("uid"), F.lit(0).alias("n_tokens"), F.lit("").alias("limit_name"), F.lit(1).alias("capacity")).limit(0)
    parts = each.withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")).withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
    first = ((F.col("part_no") - 1) * F.col("capacity")).cast("int")
    parts = parts.withColumn("first_token", first).withColumn("size", F.least("capacity", F.col("n_tokens") - first))
    loose = parts.where((F.col("size") > 0) & (F.col("size") < F.col("capacity"))).select("limit_name", "capacity", "uid", "part_no", "size")
    totals = staged(parts.groupBy("limit_name", "capacity").agg(F.count_if(F.col("size") == F.col("capacity")).alias("n_full"), F.sum(F.when(F.col("size") < F.col("capacity"), F.col("size")).otherwise(0)).alias("n_loose"), F.count_if((F.col("size") > 0) & (F.col("size") < F.col("capacity"))).alias("n_items")), "totals")
    bounds = {r.limit_name: (-(-r.n_loose // r.capacity), r.n_items) for r in totals.collect()}  # a row for each capacity
    tasks = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_sets = {name: n // search.set_items + 1 for name, (_, n) in bounds.items()}
    of = F.create_map(*[F.lit(x) for pair in n_sets.items() for x in pair]) if n_sets else F.lit(None).cast("map<string,int>")
    todo = loose.withColumn("set_no", F.pmod(F.xxhash64("uid", "part_no"), of[F.col("limit_name")].cast("bigint")))
    kept: list[DataFrame] = []
    n_kept: dict[str, int] = dict.fromkeys(bounds, 0)
    fit, round_ = None, 0
    while True:
        once, begun = _pack_sets(todo, search, tasks, f"pack{round_}")
        if fit is None:
            fit = begun
        else:
            drop(begun)
        loads = staged(once.groupBy("limit_name", "capacity", "set_no", "bin").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")), "loads")
        # The containers of a set that aren't full, from the emptiest on: a set has few containers, ranked within it.
        ranked = loads.groupBy("limit_name", "capacity", "set_no").agg(F.array_sort(F.collect_list(F.struct("load", "bin", "n"))).alias("all"))
        spare = F.filter("all", lambda b, i: (b["load"] < F.col("capacity")) & (i < F.greatest(F.lit(1), F.floor(F.size("all") / 4))))
        ranked = staged(ranked.select(*_SET, F.size("all").alias("n_bins"), spare.alias("spare")), "spare")
        per = {r.limit_name: r for r in ranked.groupBy("limit_name").agg(F.sum("n_bins").alias("n_bins"), F.sum(F.size("spare")).alias("n_spare"), F.sum(F.aggregate("spare", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])).alias("n_items")).collect()}
        again = [name for name, r in per.items() if n_sets[name] > 1 and n_kept[name] + r.n_bins > bounds[name][0]]
        name_of = F.concat(F.lit(f"r{round_}."), "set_no", F.lit("."), "bin").alias("container")
        spared = ranked.where(F.col("limit_name").isin(again)).select(*_SET, F.explode("spare.bin").alias("bin"))
        kept.append(once.join(spared, [*_SET, "bin"], "left_anti").select("limit_name", "uid", "part_no", name_of))
        if not again:
            break
        before = dict(n_sets)
        for name in again:
            n_kept[name] += per[name].n_bins - per[name].n_spare
            n_sets[name] = min(-(-before[name] // 4), -(-per[name].n_items // search.set_items))
        of = F.create_map(*[F.lit(x) for name in again for x in (name, n_sets[name])])
        todo = once.join(spared, [*_SET, "bin"], "left_semi").withColumn("set_no", F.pmod("set_no", of[F.col("limit_name")].cast("bigint"))).select("limit_name", "capacity", "set_no", "uid", "part_no", "size")
        round_ += 1
    full = F.when(F.col("size") == F.col("capacity"), F.concat(F.lit("c"), "uid", F.lit("."), "part_no"))
    out = parts.join(union_all(kept), ["limit_name", "uid", "part_no"], "left")
    placed = out.select("limit_name", F.col("key").alias(key), "part_no", "n_parts", "first_token", F.col("size").alias("n_tokens"), F.coalesce("container", full).alias("container"))
    start = totals.join(fit.groupBy("limit_name").agg(F.sum("n_fit").alias("n_fit")), "limit_name", "left").select("limit_name", "capacity", "n_full", "n_loose", F.coalesce("n_fit", F.lit(0)).alias("n_fit"))
    return Packed(placed, start)


def pack(df: DataFrame, key: str, text: str, capacities: list[Capacity], folder: str | None = None, search: Search = Search()) -> DataFrame:
    """``limit_name, key, part_no, n_parts, first_token, n_tokens, container`` for every row of ``df`` and capacity.

    A text is one part unless it alone exceeds the capacity; then it is divided into parts of the full capacity, each a
    container of its own, and a rest that is packed like other texts. The tokens of a container's parts add up to no
    more than the capacity. Null and empty texts have no tokens and need no container: one part with a null container.
    Repeated rows and keys are packed each for itself. Capacities below 1 and repeated names raise ValueError; without
    any there are no rows.
    """
    return packed(df, key, text, capacities, folder, search).parts


def read_capacities(limits: DataFrame) -> list[Capacity]:
    """The container capacities of a settings table, read on the driver. More than ``MAX_LIMITS`` raise ValueError.

    A null or empty tokenizer is ``byte_bpe_50k``.
    """
    name = F.coalesce(F.nullif(F.trim("tokenizer"), F.lit("")), F.lit("byte_bpe_50k"))
    rows = limits.where(F.col("used_for") == "container").select("limit_name", "max_tokens", F.concat(name, F.lit(".json"))).limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} capacities")
    return [Capacity(*r) for r in rows]


def _of_documents(spark: SparkSession, d: str) -> Packed:
    return packed(table(spark, d, "documents"), "doc_id", "text", read_capacities(table(spark, d, "size_limits")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """All documents in the containers of size_limits."""
    return _of_documents(spark, d).parts


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, tokens in them, the share of the room that is used, the least number of containers that
    any packing needs, and what best fit decreasing of the sets dealt first came to."""
    parts, start = _of_documents(spark, d)
    used = parts.where("container is not null").groupBy("limit_name").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    bound = F.col("n_full") + F.ceil(F.col("n_loose") / F.col("capacity"))
    return used.join(start, "limit_name").select("limit_name", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4).alias("filled"), bound.alias("n_least"), (F.col("n_full") + F.col("n_fit")).alias("n_start"))


def p7_parts(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any right packing: per text and capacity, its parts and their tokens; per capacity, no container above it."""
    parts = p7_containers(spark, d)
    loads = parts.where("container is not null").groupBy("limit_name", "container").agg(F.sum("n_tokens").alias("load"))
    most = loads.groupBy("limit_name").agg(F.max("load").alias("fullest"))
    sums = parts.groupBy("limit_name").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("container").isNull()).alias("n_without"))
    limits = table(spark, d, "size_limits").where("used_for = 'container'").select("limit_name", "max_tokens")
    return sums.join(most, "limit_name").join(limits, "limit_name").select("limit_name", "n_docs", (F.col("n_parts") >= F.col("n_docs")).alias("whole"), (F.col("fullest") <= F.col("max_tokens")).alias("within"), "n_without")


def queries() -> dict:
    return {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_parts": p7_parts}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_parts": """SELECT limit_name, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, true AS whole, true AS within,
  (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS n_without FROM size_limits WHERE used_for = 'container'""",
    }
