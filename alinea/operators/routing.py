"""From many targets to few: families by profile, then a shortlist with a quota for base entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from alinea.operators.fusion import rrf
from alinea.operators.lexical import ranked


def target_text(with_guidance: bool = False) -> Column:
    """What a control is indexed on: key, title, family and statement, with its guidance if wanted."""
    base = F.concat("control_id", F.lit(" "), F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("family_title", F.lit("")), F.lit(". "), F.coalesce("statement", F.lit("")))
    return F.concat_ws(" ", base, F.nullif("guidance", F.lit(""))) if with_guidance else base


def _joined(*parts: Column) -> Column:
    """Parts that aren't empty, by blanks."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def focal_text(title: Column, principle: Column, above: Column, text: Column) -> Column:
    """What a clause is routed on: its subdomain's heading and principle, the texts above it from the root down, and its own (rolled up, where it has items)."""
    return _joined(title, principle, above, text)


def area_text(title: Column, principle: Column, objective: Column) -> Column:
    """What a subdomain is routed on: heading, principle, objective."""
    return _joined(title, principle, objective)


def asked_text(title: Column, parent: Column, text: Column, above: Column | None = None, mode: str = "parent") -> Column:
    """What a clause is retrieved by: its own text alone (``clause``), with heading and parent (``parent``), or with heading and all texts above (``context``)."""
    if mode not in ("clause", "parent", "context"):
        raise ValueError(mode)
    return {"clause": lambda: _joined(text), "parent": lambda: _joined(title, parent, text), "context": lambda: _joined(title, above, text)}[mode]()


def family_profiles(controls: DataFrame) -> DataFrame:
    """``family, family_title, n_base, n_total, profile``: the family's title and its base entries' titles in key order."""
    base = ~F.col("is_enhancement")
    titles = F.array_sort(F.collect_list(F.when(base, F.struct("control_id", "title"))))
    grouped = controls.groupBy("family").agg(F.min("family_title").alias("family_title"), F.count_if(base).alias("n_base"), F.count(F.lit(1)).alias("n_total"), titles.alias("t"))
    return grouped.select("family", "family_title", "n_base", "n_total", F.concat("family_title", F.lit(". "), F.array_join(F.transform("t", lambda x: x["title"]), "; ")).alias("profile"))


def route(own: DataFrame, prior: DataFrame, prior_key: DataFrame, k: int, dense: DataFrame | None = None) -> DataFrame:
    """``query, item, score, rank``: the query's own ranked lists (lexical, then dense, if given) fused with that of the group it belongs to.

    ``prior`` is ranked by group, ``prior_key`` has ``query, group``; queries without a group have their own lists only.
    """
    of_group = prior_key.join(prior.withColumnRenamed("query", "group"), "group").select("query", "item", "rank")
    lists = [own, *([dense] if dense is not None else []), of_group]
    return rrf(*lists).where(F.col("rank") <= k).select("query", "item", "score", "rank")


def route_single(lexical: DataFrame, dense: DataFrame | None = None, k: int = 3) -> DataFrame:
    """``query, item, score, rank`` of queries routed on their own: the fused lists, or the lexical one with its own scores where there is no dense one."""
    if dense is None:
        return lexical.where(F.col("rank") <= k).select("query", "item", "score", "rank")
    return rrf(lexical, dense).where(F.col("rank") <= k).select("query", "item", "score", "rank")


def missing_routes(targets: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """One row: ``n_targets``, ``n_missing`` (targets without a route) and ``complete``; routes that aren't complete are made anew for all."""
    left = targets.select(key).join(routes.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    out = left.agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("_r").isNull()).alias("n_missing"))
    return out.withColumn("complete", F.col("n_missing") == 0)


def shortlist(lexical: DataFrame, dense: DataFrame | None, targets: DataFrame, routes: DataFrame, n: int = 10, base_quota: float | None = 0.7) -> DataFrame:
    """``query, control_id, score, rank, bm25_rank, dense_rank, parent_lifted, is_enhancement, family``.

    ``lexical`` and ``dense`` are scored pairs (query, item, score) over all targets, cut to the families of ``routes``
    (query, family) and the best 5n. An enhancement in the pool lifts its base entry to its own rank, as a further
    list. Of the fused order, base entries get a share of the n places and enhancements the rest; places that one
    kind leaves go to the next best of either. A null quota takes the fused order as it is.
    """
    allowed = targets.select(F.col("control_id").alias("item"), "family", "is_enhancement", "parent_id")
    lists = []
    for scored in (lexical, dense):
        if scored is not None:
            inside = scored.join(allowed.select("item", "family"), "item").join(routes.select("query", "family"), ["query", "family"])
            lists.append(ranked(inside.select("query", "item", "score"), 5 * n).select("query", "item", "rank"))
    pool = rrf(*lists)
    enhanced = pool.join(allowed.where(F.col("is_enhancement") & F.col("parent_id").isNotNull()), "item")
    up = enhanced.select("query", F.col("parent_id").alias("item"), F.col("rank").alias("at"))
    up = up.join(allowed.select("item", "family"), "item").join(routes.select("query", "family"), ["query", "family"], "left_semi")
    lifted = up.groupBy("query", "item").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query").orderBy("at", "item")
    fused = rrf(*lists, lifted.select("query", "item", F.row_number().over(order).alias("rank")))
    r = F.col("list_ranks")
    met = fused.join(allowed, "item")
    if base_quota is None:
        chosen = F.lit(True)
    else:
        n_base = F.lit(max(1, round(n * base_quota)))
        within = Window.partitionBy("query", "is_enhancement").orderBy("rank")
        met = met.withColumn("_k", F.row_number().over(within))
        chosen = F.col("_k") <= F.when(F.col("is_enhancement"), n - n_base).otherwise(n_base)
    first = Window.partitionBy("query").orderBy((~chosen).cast("int"), "rank")
    picked = met.withColumn("_p", F.row_number().over(first)).where(F.col("_p") <= n)
    place = Window.partitionBy("query").orderBy("rank")
    lex_rank, dense_rank, lift_rank = r[0], (r[1] if dense is not None else F.lit(None).cast("int")), r[len(lists)]
    return picked.select(
        "query", F.col("item").alias("control_id"), "score", F.row_number().over(place).alias("rank"), lex_rank.alias("bm25_rank"), dense_rank.alias("dense_rank"),
        (lift_rank.isNotNull() & lex_rank.isNull() & dense_rank.isNull()).alias("parent_lifted"), "is_enhancement", "family",
    )


def recall_at(ranks: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """``k, n_groups, n_hit, recall``: the share of groups with an expected item among their first ``k``.

    ``ranks``: query, item, rank; ``expected``: query, item. Queries without expected items don't count.
    """
    by = first_hits(ranks, expected).select("first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = F.count_if(F.col("first") <= F.col("k"))
    return by.groupBy("k").agg(F.count(F.lit(1)).alias("n_groups"), hit.alias("n_hit"), F.round(hit / F.count(F.lit(1)), 6).alias("recall"))


def first_hits(ranks: DataFrame, expected: DataFrame) -> DataFrame:
    """``query, first``: the rank of the first expected item, null without one."""
    return expected.join(ranks, ["query", "item"], "left").groupBy("query").agg(F.min("rank").alias("first"))


def recall_by_group(ranks: DataFrame, expected: DataFrame, groups: DataFrame, k: int, weak: float = 0.6) -> DataFrame:
    """``group, n, n_hit, recall, weak``: recall at ``k`` of each group of queries (``groups``: query, group), and whether it is below ``weak``."""
    met = first_hits(ranks, expected).join(groups, "query").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") <= k).alias("n_hit"))
    share = F.col("n_hit") / F.col("n")
    return met.select("group", "n", "n_hit", F.round(share, 6).alias("recall"), (share < weak).alias("weak"))
