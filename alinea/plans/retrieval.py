"""Queries over clauses (focal side), controls (target side), documents and embeddings: index, ranking, routing, shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.functions.keys import norm_key
from alinea.functions.text import TOKEN, STOP, collapse, tokens
from alinea.operators.current import current
from alinea.operators.fusion import Cells, answers, dense_top, dense_top_in_cells, dense_top_in_groups, hybrid_search, provenance, rrf
from alinea.operators.hierarchy import ancestors, chain_text, children, inherit, path_order, roll_up
from alinea.operators.lexical import BROADCAST_POSTINGS, bm25_scores, bm25_top, impacts, postings, ranked, term_stats
from alinea.operators.onepass import FEW_TARGETS, Impacts, Router, Shortlister, Vectors
from alinea.operators.routing import area_text, asked_text, family_profiles, first_hits, focal_text, missing_routes, recall_at, recall_by_group, route, route_single, shortlist, target_text
from alinea.plans.skew import checked_broadcast, skew_join
from alinea.plans.stage import once, staged
from alinea.sources.files import read_vectors
from alinea.sources.tables import table

FAMILIES, PLACES = 5, 10


#: Columns that index texts, profiles and the clause tree are made of.
INDEXED, PROFILED = ("title", "family_title", "statement"), ("family", "family_title", "title", "is_enhancement")
TREE = ("parent_id", "path", "text", "framework", "subdomain", "subdomain_title", "clause_type", "deontic")


def active_controls(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Controls that hold now, with ``columns`` (all, if none are named)."""
    return current(table(spark, d, "controls"), "control_id", "loaded_at", "withdrawn_at", ("withdrawn", *columns) if columns else ()).where(~F.col("withdrawn"))


def active_clauses(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Clauses that hold now, their texts collapsed, with ``columns`` (all, if none are named)."""
    c = current(table(spark, d, "clauses"), "clause_id", "loaded_at", "retired_at", columns)
    return c.withColumn("text", collapse("text")) if "text" in c.columns else c


def _clause_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def make():
        clauses = staged(active_clauses(spark, d, *TREE), "clauses")
        return clauses, ancestors(clauses, "clause_id", "parent_id")

    return once(spark, d, ("clauses",), "clause tree", make)


def _routable(clauses: DataFrame, kids: DataFrame) -> DataFrame:
    """Leaves that state something themselves."""
    return clauses.drop("n_children", "child_ids").join(kids, "clause_id").where((F.col("clause_type") != "referential") & (F.col("n_children") == 0))


def _leaf_queries(spark: SparkSession, d: str) -> DataFrame:
    """Routable clauses with ``own`` (text rolled up), ``context`` (headings and ancestors before it) and ``asked`` (with the parent's text)."""
    def make():
        clauses, closure = _clause_tree(spark, d)
        kids = children(clauses, "clause_id", "parent_id", path_order("path"))
        leaves = _routable(clauses, kids)
        chain = chain_text(clauses, closure, "clause_id", "text")
        parents = clauses.select(F.col("clause_id").alias("parent_id"), F.col("text").alias("parent_text"))
        full = leaves.join(chain, "clause_id", "left").join(parents, "parent_id", "left")
        title, none = F.col("subdomain_title"), F.lit(None).cast("string")  # the clauses table has no principle
        out = full.select("clause_id", F.concat_ws("/", "framework", "subdomain").alias("area"), "subdomain_title", "text", focal_text(title, none, F.col("chain"), F.col("text")).alias("context"), asked_text(title, F.col("parent_text"), F.col("text")).alias("asked"))
        return staged(out, "leaves")

    return once(spark, d, ("clauses",), "leaves", make)


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each active control's index text."""
    t = active_controls(spark, d, *INDEXED).select("control_id", tokens(target_text()).alias("t"))
    return t.select("control_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


def term_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of each term of the active controls."""
    items = active_controls(spark, d, *INDEXED).select("control_id", target_text().alias("t"))
    return term_stats(postings(items, "control_id", "t"), items).select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, ("controls",), "impacts", lambda: staged(impacts(active_controls(spark, d, *INDEXED).select("control_id", target_text().alias("t")), "control_id", "t"), "impacts"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best 10 active controls of each routable clause by BM25."""
    top = bm25_top(_leaf_queries(spark, d), "clause_id", "asked", _index(spark, d), PLACES)
    return top.select(F.col("query").alias("clause_id"), F.col("item").alias("control_id"), "score", "rank")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read_vectors(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 20."""
    e = _embeddings(spark, d)
    return dense_top(e.where("vec_id % 20 = 0"), "vec_id", e, "vec_id", "embedding", 10)


def dense_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of the exact 10 nearest vectors the search in cells finds, over all queries."""
    e = _embeddings(spark, d)
    asked = e.where("vec_id % 20 = 0")
    exact = dense_top(asked, "vec_id", e, "vec_id", "embedding", 10).select("query", "item")
    found = dense_top_in_cells(asked, "vec_id", e, "vec_id", "embedding", 10, Cells.fit(e, "embedding", 32), 20).select("query", "item", F.lit(1).alias("f"))
    return exact.join(found, ["query", "item"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("n_found"), F.round(F.count("f") / F.count(F.lit(1)), 6).alias("recall"))


def dense_recall(spark: SparkSession, d: str) -> DataFrame:
    """How often a vector of the same label is among the first 1, 3, 5 neighbours other than the vector itself."""
    e = table(spark, d, "embeddings")
    top = dense_top(e.where("vec_id % 20 = 0"), "vec_id", e, "vec_id", "embedding", 10).where("query <> item")
    labels = e.select("vec_id", "label")
    met = top.join(labels.toDF("query", "ql"), "query").join(labels.toDF("item", "il"), "item")
    first = met.groupBy("query").agg(F.min(F.when(F.col("ql") == F.col("il"), F.col("rank") - 1)).alias("first"))
    by = first.select("first", F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("k"))
    hit = F.count_if(F.col("first") <= F.col("k"))
    return by.groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), hit.alias("n_hit"), F.round(hit / F.count(F.lit(1)), 6).alias("recall"))


def _document_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 20 = 0 and title_en is not null")

    def make():
        # Many documents share a title: each is searched for once.
        titles = staged(asked.select("title_en").distinct(), "titles")
        terms = staged(titles.select(F.explode(tokens("title_en")).alias("term")).distinct(), "asked-terms")
        index = staged(impacts(docs, "doc_id", "text", asked=terms), "impacts")
        return staged(bm25_top(titles, "title_en", "title_en", index, 40), "best")

    best = once(spark, d, ("documents",), "titles", make)
    best = checked_broadcast(best, best.count()).withColumnRenamed("query", "title_en")  # 40 rows a title: Spark would go by the compressed files
    lexical = skew_join(asked.select(F.col("doc_id").alias("query"), "title_en"), best, ["title_en"], "inner").select("query", "item", "score", "rank")
    e = _embeddings(spark, d).withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    dense = dense_top(e.join(asked.select("doc_id"), "doc_id", "left_semi"), "doc_id", e, "doc_id", "embedding", 40)
    return docs, lexical, dense


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Titles of documents against texts, and their vectors against vectors, fused by rank, with where each hit came from."""
    _, lexical, dense = _document_lists(spark, d)
    f = rrf(lexical, dense)
    return f.select("query", "item", "score", "rank", provenance(F.col("list_ranks")[0], F.col("list_ranks")[1]).alias("found_by"))


def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The best 8 binding documents of the fused pools of 40."""
    docs, lexical, dense = _document_lists(spark, d)
    hits = hybrid_search(lexical, dense, docs.select("doc_id", "status", "source"), "doc_id", 8, F.col("status") == "binding")
    return hits.select("query", "doc_id", "score", "place", "status", "source", "bm25_rank", "dense_rank")


def answered(spark: SparkSession, d: str) -> DataFrame:
    """For every asked title how many draft documents the fused pools hold, and the refusal where there is none."""
    docs, lexical, dense = _document_lists(spark, d)
    hits = hybrid_search(lexical, dense, docs.select("doc_id", "status"), "doc_id", 8, F.col("status") == "draft")
    return answers(docs.where("doc_id % 20 = 0 and title_en is not null"), "doc_id", hits)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """One profile text for each family of active controls."""
    return family_profiles(active_controls(spark, d, *PROFILED))


def _profile_index(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, ("controls",), "profile impacts", lambda: staged(impacts(profiles(spark, d), "family", "profile"), "profiles"))


def _areas(leaves: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return leaves.groupBy("area").agg(F.min("subdomain_title").alias("title")).select("area", area_text(F.col("title"), none, none).alias("title"))


def _routes(spark: SparkSession, d: str, leaves: DataFrame) -> DataFrame:
    def make():
        index, areas = _profile_index(spark, d), _areas(leaves)
        own = bm25_top(leaves, "clause_id", "context", index)
        prior = rrf(bm25_top(areas, "area", "title", index)).select("query", "item", "rank")
        return staged(route(own, prior, leaves.select(F.col("clause_id").alias("query"), F.col("area").alias("group")), FAMILIES), "routes")

    return once(spark, d, ("clauses", "controls"), "routes", make)


def _vectors(spark: SparkSession, d: str, df: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``df`` with ``embedding``: a stand-in for a model's vectors of its keys, rows of embeddings dealt by a hash that SQL has, too."""
    e = _embeddings(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    at = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint")
    return df.crossJoin(F.broadcast(n)).withColumn("vec_id", at % F.col("_n")).join(checked_broadcast(e, e.count()), "vec_id", how).drop("vec_id", "_n")  # n: one row


def _routes_dense(spark: SparkSession, d: str, leaves: DataFrame) -> DataFrame:
    """Routes by text and vectors: the clause's two lists and the fused one of its area."""
    def make():
        index, areas = _profile_index(spark, d), _areas(leaves)
        families = _vectors(spark, d, profiles(spark, d).select("family"), "family")
        own, of_area = bm25_top(leaves, "clause_id", "context", index), bm25_top(areas, "area", "title", index)
        dense = lambda df, key: dense_top(_vectors(spark, d, df.select(key), key), key, families, "family", "embedding", 1000)  # noqa: E731, all families
        prior = rrf(of_area, dense(areas, "area")).select("query", "item", "rank")
        return staged(route(own, prior, leaves.select(F.col("clause_id").alias("query"), F.col("area").alias("group")), FAMILIES, dense(leaves, "clause_id")), "routes")

    return once(spark, d, ("clauses", "controls", "embeddings"), "dense routes", make)


def routes(spark: SparkSession, d: str) -> DataFrame:
    """The 5 families that each routable clause goes to."""
    r = _routes(spark, d, _leaf_queries(spark, d))
    return r.select(F.col("query").alias("clause_id"), F.col("item").alias("family"), "score", "rank")


def routes_dense(spark: SparkSession, d: str) -> DataFrame:
    """The 5 families that each routable clause goes to by text and vectors."""
    r = _routes_dense(spark, d, _leaf_queries(spark, d))
    return r.select(F.col("query").alias("clause_id"), F.col("item").alias("family"), "score", "rank")


def routes_single(spark: SparkSession, d: str) -> DataFrame:
    """The 3 families that each subdomain's heading alone goes to."""
    r = route_single(bm25_top(_areas(_leaf_queries(spark, d)), "area", "title", _profile_index(spark, d)))
    return r.select(F.col("query").alias("area"), F.col("item").alias("family"), "score", "rank")


def routes_complete(spark: SparkSession, d: str) -> DataFrame:
    """Whether every routable clause has a route."""
    leaves = _leaf_queries(spark, d)
    return missing_routes(leaves, _routes(spark, d, leaves).select(F.col("query").alias("clause_id")), "clause_id")


def route_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each family is chosen, with a bar of up to 40 marks; families never chosen have 0 and no bar."""
    chosen = _routes(spark, d, _leaf_queries(spark, d)).groupBy(F.col("item").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    all_ = active_controls(spark, d, "family").select("family").distinct().join(chosen, "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))
    most = all_.agg(F.max("n").alias("most"))
    bar = F.when(F.col("n") > 0, F.expr("repeat('#', int(greatest(1, n * 40 div most)))")).otherwise("")
    return all_.crossJoin(F.broadcast(most)).select("family", "n", bar.alias("bar"))  # most: one row


def route_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clause and control without and with routing, and the reduction in whole percent."""
    leaves = _leaf_queries(spark, d)
    per = active_controls(spark, d, "family").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    routed = _routes(spark, d, leaves).join(per.withColumnRenamed("family", "item"), "item").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs_routed"))
    n = leaves.agg(F.count(F.lit(1)).alias("n_clauses")).crossJoin(per.agg(F.sum("n").alias("n_controls")))  # one row each
    out = n.crossJoin(routed).withColumn("pairs_full", F.col("n_clauses") * F.col("n_controls"))
    return out.select("n_clauses", "n_controls", "pairs_full", "pairs_routed", F.expr("100 - 100 * pairs_routed div pairs_full").alias("reduction"))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """The truth that retrieval is held against: query, control_id, family of what reviewers found right, for active clauses."""
    keys = active_clauses(spark, d, "framework", "subdomain").select(F.col("clause_id").alias("query"), norm_key("clause_id").alias("clause"), F.concat_ws("/", "framework", "subdomain").alias("area"))
    r = table(spark, d, "review").where("label = 'correct'").select(norm_key("clause_id").alias("clause"), norm_key("control_id").alias("control_id")).where("control_id is not null")
    return r.join(keys, "clause").select("query", "area", "control_id", F.split_part("control_id", F.lit("-"), F.lit(1)).alias("family")).distinct()


def _wanted_families(spark: SparkSession, d: str, leaves: DataFrame) -> DataFrame:
    """Of every routable clause of an area with reviewed findings, the families that these name."""
    return leaves.select(F.col("clause_id").alias("query"), "area").join(_expected(spark, d).select("area", F.col("family").alias("item")).distinct(), "area").select("query", "item")


def route_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of routing at 1, 2, 3, 5 against the families that reviewed findings of a clause's area name."""
    leaves = _leaf_queries(spark, d)
    return recall_at(_routes(spark, d, leaves), _wanted_families(spark, d, leaves), [1, 2, 3, 5])


def route_recall_areas(spark: SparkSession, d: str) -> DataFrame:
    """Recall of routing at 3 by area, and which areas are weak."""
    leaves = _leaf_queries(spark, d)
    groups = leaves.select(F.col("clause_id").alias("query"), F.col("area").alias("group"))
    return recall_by_group(_routes(spark, d, leaves), _wanted_families(spark, d, leaves), groups, 3).withColumnRenamed("group", "area")


def _shortlist_of(spark: SparkSession, d: str, chosen: DataFrame, vectors: bool) -> DataFrame:
    leaves, controls = _leaf_queries(spark, d), staged(active_controls(spark, d, *INDEXED, "family", "is_enhancement", "parent_id"), "controls")
    grouped = _index(spark, d).join(controls.select(F.col("control_id").alias("item"), F.col("family").alias("group")), "item")
    limits = chosen.groupBy(F.col("query").alias("clause_id")).agg(F.collect_list("family").alias("families"))
    # Weights come from all controls; only those of the routed families are ranked.
    scores = bm25_top(leaves.join(limits, "clause_id"), "clause_id", "asked", grouped, 5 * PLACES, "families").select("query", "item", "score")
    dense = None
    if vectors:
        asked = _vectors(spark, d, chosen, "query")
        dense = dense_top_in_groups(asked, "query", _vectors(spark, d, controls.select("control_id", "family"), "control_id"), "control_id", "embedding", "family", 5 * PLACES).select("query", "item", "score")
    return staged(shortlist(scores, dense, controls, chosen, PLACES), "shortlists")


def _shortlists(spark: SparkSession, d: str) -> DataFrame:
    chosen = lambda: _routes(spark, d, _leaf_queries(spark, d)).select("query", F.col("item").alias("family"))
    return once(spark, d, ("clauses", "controls"), "shortlists", lambda: _shortlist_of(spark, d, chosen(), False))


def _shortlists_in_one_pass(spark: SparkSession, d: str, controls: DataFrame) -> DataFrame:
    """``shortlists_dense`` for controls that were counted few: they go to every task, and of a clause only its shortlist leaves its task."""
    leaves = _leaf_queries(spark, d)
    families = sorted(map(tuple, _vectors(spark, d, controls.select("family").distinct(), "family", "left").collect()))  # as many as families
    targets = sorted(_vectors(spark, d, controls, "control_id", "left").collect(), key=lambda r: r.control_id)  # at most FEW_TARGETS
    names, keys = [f for f, _ in families], [r.control_id for r in targets]
    weights = lambda index, items: Impacts(index.select("term", "item", "impact").toArrow(), items)  # noqa: E731, at most BROADCAST_POSTINGS
    router = Router(names, weights(_profile_index(spark, d), names), Vectors([v for _, v in families]))
    lister = Shortlister(router, keys, [r.family for r in targets], [r.is_enhancement for r in targets], [r.parent_id for r in targets], weights(_index(spark, d), keys), Vectors([r.embedding for r in targets]), PLACES, routed=FAMILIES)
    areas = _vectors(spark, d, _areas(leaves), "area", "left").select("area", tokens("title").alias("title"), "embedding")
    prior = staged(areas.mapInArrow(router.priors, "area string, prior array<int>"), "prior")
    asked = _vectors(spark, d, leaves.select("clause_id", "area", "context", "asked").join(prior, "area", "left"), "clause_id", "left")
    return asked.select("clause_id", tokens("context").alias("context"), tokens("asked").alias("asked"), "prior", "embedding").mapInArrow(lister.run, Shortlister.SCHEMA)


def shortlists_dense(spark: SparkSession, d: str) -> DataFrame:
    """Shortlists by text and vectors, within the families that text and vectors route to."""
    controls = staged(active_controls(spark, d, "family", "is_enhancement", "parent_id"), "controls")
    if all(x.count() <= most for x, most in ((controls, FEW_TARGETS), (_index(spark, d), BROADCAST_POSTINGS), (_profile_index(spark, d), BROADCAST_POSTINGS))) and controls.where("is_enhancement is null or family is null").isEmpty():
        return _shortlists_in_one_pass(spark, d, controls)
    chosen = _routes_dense(spark, d, _leaf_queries(spark, d)).select("query", F.col("item").alias("family"))
    s = _shortlist_of(spark, d, chosen, True)
    return s.select(F.col("query").alias("clause_id"), "control_id", "score", "rank", "bm25_rank", "dense_rank", "parent_lifted", "is_enhancement")


def shortlists(spark: SparkSession, d: str) -> DataFrame:
    """Ten controls of the routed families for each routable clause, seven places for base controls."""
    return _shortlists(spark, d).select(F.col("query").alias("clause_id"), "control_id", "score", "rank", "bm25_rank", "parent_lifted", "is_enhancement")


def shortlist_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per family: shortlisted pairs, those of enhancements, lifted ones, distinct controls, and controls never reached."""
    s = _shortlists(spark, d)
    per = active_controls(spark, d, "family").groupBy("family").agg(F.count(F.lit(1)).alias("n_controls"))
    got = s.groupBy("family").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_enhancement").alias("n_enhancements"), F.count_if("parent_lifted").alias("n_lifted"), F.count_distinct("control_id").alias("n_reached"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pairs", "n_enhancements", "n_lifted", "n_reached")]
    return per.join(got, "family", "left").select("family", "n_controls", *zero, (F.col("n_controls") - F.coalesce("n_reached", F.lit(0))).alias("n_never"))


def never_shortlisted(spark: SparkSession, d: str) -> DataFrame:
    """Active controls on no shortlist."""
    return active_controls(spark, d, "family").select("control_id", "family").join(_shortlists(spark, d).select("control_id"), "control_id", "left_anti")


def shortlist_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the shortlists at 3, 5, 10 against the controls that reviewers found right for the clause."""
    return recall_at(*_shortlist_truth(spark, d), [3, 5, 10])


def shortlist_hits(spark: SparkSession, d: str) -> DataFrame:
    """For each clause with reviewed findings the rank of the first right control, and what was wanted; null for a miss."""
    s, want = _shortlist_truth(spark, d)
    wanted = want.groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("wanted"))
    return first_hits(s, want).join(wanted, "query").select(F.col("query").alias("clause_id"), "wanted", "first")


def _shortlist_truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _shortlists(spark, d).select("query", F.col("control_id").alias("item"), "rank")
    return s, _expected(spark, d).select("query", F.col("control_id").alias("item")).distinct().join(s.select("query").distinct(), "query", "left_semi")


def shortlist_reach(spark: SparkSession, d: str) -> DataFrame:
    """One row: shortlists, pairs, enhancements with their whole percentage, and the share of active controls reached."""
    s = _shortlists(spark, d).agg(F.count_distinct("query").alias("n_shortlists"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_enhancement").alias("n_enhancements"), F.count_distinct("control_id").alias("n_reached"))
    n = active_controls(spark, d, "family").agg(F.count(F.lit(1)).alias("n_controls"))
    out = s.crossJoin(n)  # one row each
    return out.select("*", F.expr("100 * n_enhancements div greatest(n_pairs, 1)").alias("enhancement_percent"), F.round(F.col("n_reached") / F.col("n_controls"), 6).alias("reach"))


def most_shortlisted(spark: SparkSession, d: str) -> DataFrame:
    """The 10 controls that are on most shortlists."""
    return _shortlists(spark, d).groupBy("control_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "control_id").limit(10)


def clause_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of each clause in order."""
    kids = children(active_clauses(spark, d, "parent_id", "path"), "clause_id", "parent_id", path_order("path"))
    return kids.select("clause_id", "n_children", F.array_join("child_ids", "|").alias("child_ids"))


def clause_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Every clause with each of its ancestors."""
    return _clause_tree(spark, d)[1].select(F.col("node").alias("clause_id"), "ancestor", "distance")


def inherited_modal(spark: SparkSession, d: str) -> DataFrame:
    """Each clause's modal verb, from the nearest ancestor where it has none."""
    clauses, closure = _clause_tree(spark, d)
    return inherit(clauses, closure, "clause_id", "deontic").withColumnRenamed("own", "deontic_own")


def clause_full_text(spark: SparkSession, d: str) -> DataFrame:
    """Each clause's text with its descendants' behind it."""
    clauses, closure = _clause_tree(spark, d)
    return roll_up(clauses, closure, "clause_id", "text", path_order("path"))


def routing_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts that each routable clause is routed and retrieved by."""
    return _leaf_queries(spark, d).select("clause_id", "context", "asked")


_STOPS = ", ".join(f"'{w}'" for w in STOP)


def _tok(text: str) -> str:
    pattern = TOKEN.replace("'", "''")
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '{pattern}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOPS}) AND length(x) > 1)"


_TEXT = "control_id || ' ' || coalesce(title, '') || '. ' || coalesce(family_title, '') || '. ' || coalesce(statement, '')"
_CTL = "ctl AS (SELECT * FROM (SELECT * FROM controls QUALIFY row_number() OVER (PARTITION BY control_id ORDER BY loaded_at DESC) = 1) WHERE withdrawn_at IS NULL AND NOT withdrawn)"
_SPACE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_CLA = f"cla AS (SELECT * REPLACE ({_SPACE} AS text) FROM (SELECT * FROM clauses QUALIFY row_number() OVER (PARTITION BY clause_id ORDER BY loaded_at DESC) = 1) WHERE retired_at IS NULL)"
_ANC = """anc AS (SELECT c.clause_id AS node, p.clause_id AS ancestor, 1 AS distance, p.parent_id AS up FROM cla c JOIN cla p ON c.parent_id = p.clause_id
  UNION ALL SELECT a.node, p.clause_id, a.distance + 1, p.parent_id FROM anc a JOIN cla p ON a.up = p.clause_id)"""
_LEAF = """chain AS (SELECT node, string_agg(p.text, ' ' ORDER BY distance DESC) AS chain FROM anc JOIN cla p ON p.clause_id = ancestor GROUP BY 1),
leaf AS (SELECT c.clause_id, c.framework || '/' || c.subdomain AS area, c.subdomain_title, c.text,
  concat_ws(' ', nullif(c.subdomain_title, ''), nullif(chain, ''), nullif(c.text, '')) AS context,
  concat_ws(' ', nullif(c.subdomain_title, ''), nullif(p.text, ''), nullif(c.text, '')) AS asked
  FROM cla c LEFT JOIN chain ON node = c.clause_id LEFT JOIN cla p ON p.clause_id = c.parent_id
  WHERE c.clause_type <> 'referential' AND NOT EXISTS (SELECT 1 FROM cla k WHERE k.parent_id = c.clause_id))"""


def _bm25(index: str, asked: str, name: str) -> str:
    """CTEs: ``{name}`` (query, item, score) for items ``index`` (item, t) and queries ``asked`` (query, t)."""
    return f"""{name}_tok AS (SELECT item, {_tok('t')} AS toks FROM ({index})),
{name}_post AS (SELECT item, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT item, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok) GROUP BY 1, 2),
{name}_n AS (SELECT count(*) AS n, avg(len(toks)) AS mean_dl FROM {name}_tok),
{name}_imp AS (SELECT p.item, p.term, greatest(ln((n - df + 0.5) / (df + 0.5) + 1.0), 1e-6) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / mean_dl)) AS impact
  FROM {name}_post p JOIN (SELECT term, count(*) AS df FROM {name}_post GROUP BY 1) d ON d.term = p.term, {name}_n),
{name}_q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({_tok('t')}) AS term FROM ({asked})) GROUP BY 1, 2),
{name} AS (SELECT query, item, round(sum(qtf * impact), 6) AS score FROM {name}_q q JOIN {name}_imp i ON i.term = q.term GROUP BY 1, 2 HAVING round(sum(qtf * impact), 6) > 0)"""


_RANK = "row_number() OVER (PARTITION BY query ORDER BY score DESC, item)"
_IDX = f"SELECT control_id AS item, {_TEXT} AS t FROM ctl"
_DENSE = "SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"
_DOCS = f"""WITH {_bm25("SELECT doc_id AS item, text AS t FROM documents", "SELECT doc_id AS query, title_en AS t FROM documents WHERE doc_id % 20 = 0 AND title_en IS NOT NULL", "lex")},
l AS (SELECT *, {_RANK} AS rank FROM lex QUALIFY rank <= 40),
dn AS (SELECT * FROM ({_DENSE}) WHERE query IN (SELECT doc_id FROM documents WHERE title_en IS NOT NULL) AND item IN (SELECT doc_id FROM documents)),
d AS (SELECT *, {_RANK} AS rank FROM dn QUALIFY rank <= 40),
fused AS (SELECT coalesce(l.query, d.query) AS query, coalesce(l.item, d.item) AS item, l.rank AS lr, d.rank AS dr,
  round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 6) AS score FROM l FULL JOIN d ON l.query = d.query AND l.item = d.item),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, lr NULLS LAST, dr NULLS LAST, item) AS rank FROM fused)
"""
_PROF = """prof AS (SELECT family, min(family_title) AS family_title, count(*) FILTER (NOT is_enhancement) AS n_base, count(*) AS n_total,
  min(family_title) || '. ' || coalesce(string_agg(title, '; ' ORDER BY control_id) FILTER (NOT is_enhancement), '') AS profile FROM ctl GROUP BY 1)"""
_ROUTE = f"""WITH RECURSIVE {_CTL}, {_CLA}, {_ANC}, {_LEAF}, {_PROF},
{_bm25("SELECT family AS item, profile AS t FROM prof", "SELECT clause_id AS query, context AS t FROM leaf", "own")},
{_bm25("SELECT family AS item, profile AS t FROM prof", "SELECT area AS query, min(subdomain_title) AS t FROM leaf GROUP BY 1", "pri")},
o AS (SELECT query, item, {_RANK} AS rank FROM own),
g0 AS (SELECT query, item, {_RANK} AS rank FROM pri),
g AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(1.0::DOUBLE / (60 + rank), 6) DESC, rank) AS rank FROM g0),
p AS (SELECT clause_id AS query, item, rank FROM leaf JOIN g ON g.query = area),
fz AS (SELECT coalesce(o.query, p.query) AS query, coalesce(o.item, p.item) AS item, o.rank AS orank, p.rank AS prank,
  round(coalesce(1.0::DOUBLE / (60 + o.rank), 0) + coalesce(1.0::DOUBLE / (60 + p.rank), 0), 6) AS score FROM o FULL JOIN p ON o.query = p.query AND o.item = p.item),
routes AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, orank NULLS LAST, prank NULLS LAST, item) AS rank FROM fz QUALIFY rank <= {FAMILIES})
"""
_WANT = """want AS (SELECT DISTINCT c.clause_id AS query, c.framework || '/' || c.subdomain AS area, upper(trim(r.control_id)) AS control_id, split_part(upper(trim(r.control_id)), '-', 1) AS family
  FROM review r JOIN cla c ON upper(trim(c.clause_id)) = upper(trim(r.clause_id)) WHERE label = 'correct' AND trim(r.control_id) <> ''),
wf AS (SELECT DISTINCT l.clause_id AS query, l.area, family AS item FROM leaf l JOIN want w ON w.area = l.area)"""


def _fused(name: str, *lists: str) -> str:
    """A CTE ``{name}`` (query, item, score, list ranks r0.., rank): ranked lists (query, item, rank) fused by position."""
    n = range(len(lists))
    every = " UNION ALL ".join(f"SELECT query, item, rank, {i} AS l FROM {x}" for i, x in enumerate(lists))
    ranks = ", ".join(f"max(CASE WHEN l = {i} THEN rank END) AS r{i}" for i in n)
    order = ", ".join(f"r{i} NULLS LAST" for i in n)
    return f"{name}_u AS (SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, {ranks} FROM ({every}) GROUP BY 1, 2), {name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, {order}, item) AS rank FROM {name}_u)"


def _vec(keys: str) -> str:
    """Vectors dealt to ``keys`` (a query with a column k) by hash."""
    return f"SELECT k, e.embedding AS v FROM (SELECT k, ('0x' || substr(md5(k), 1, 6))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM ({keys})) JOIN embeddings e USING (vec_id)"


def _near(name: str, queries: str, items: str, also: str = "") -> str:
    """A CTE ``{name}`` (query, item, rank) by inner product."""
    return f"{name} AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT q.k AS query, i.k AS item, round(list_dot_product(q.v::DOUBLE[], i.v::DOUBLE[]), 6) AS score FROM ({_vec(queries)}) q, ({_vec(items)}) i {also}))"


_ROUTE_DENSE = f"""{_ROUTE[: _ROUTE.index("g AS (SELECT query")]}
{_near("fd", "SELECT clause_id AS k FROM leaf", "SELECT family AS k FROM prof")},
{_near("ad", "SELECT DISTINCT area AS k FROM leaf", "SELECT family AS k FROM prof")},
{_fused("ga", "g0", "ad")},
pd AS (SELECT clause_id AS query, item, rank FROM leaf JOIN ga ON ga.query = area),
{_fused("rd", "o", "fd", "pd")},
routes AS (SELECT query, item, score, rank FROM rd WHERE rank <= {FAMILIES})
"""
_SHORT = f"""{_ROUTE},
{_bm25(_IDX, "SELECT clause_id AS query, asked AS t FROM leaf", "sl")},
lx AS (SELECT * FROM (SELECT s.query, s.item, row_number() OVER (PARTITION BY s.query ORDER BY s.score DESC, s.item) AS rank FROM sl s JOIN ctl c ON c.control_id = s.item JOIN routes r ON r.query = s.query AND r.item = c.family) WHERE rank <= {5 * PLACES}),
pool AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(1.0::DOUBLE / (60 + rank), 6) DESC, rank) AS rank FROM lx),
lift0 AS (SELECT pool.query, c.parent_id AS item, min(pool.rank) AS lift_at FROM pool JOIN ctl c ON c.control_id = pool.item JOIN ctl b ON b.control_id = c.parent_id JOIN routes r ON r.query = pool.query AND r.item = b.family WHERE c.is_enhancement GROUP BY 1, 2),
lift AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY lift_at, item) AS rank FROM lift0),
fs AS (SELECT coalesce(x.query, y.query) AS query, coalesce(x.item, y.item) AS item, x.rank AS lr, y.rank AS ur,
  round(coalesce(1.0::DOUBLE / (60 + x.rank), 0) + coalesce(1.0::DOUBLE / (60 + y.rank), 0), 6) AS score FROM lx x FULL JOIN lift y ON x.query = y.query AND x.item = y.item),
fr AS (SELECT fs.*, is_enhancement, family, row_number() OVER (PARTITION BY query ORDER BY score DESC, lr NULLS LAST, ur NULLS LAST, item) AS pos FROM fs JOIN ctl ON control_id = item),
kk AS (SELECT *, row_number() OVER (PARTITION BY query, is_enhancement ORDER BY pos) AS k FROM fr),
pk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN k <= CASE WHEN is_enhancement THEN 3 ELSE 7 END THEN 0 ELSE 1 END, pos) AS p FROM kk QUALIFY p <= {PLACES}),
short AS (SELECT query, item AS control_id, score, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank, lr AS bm25_rank, ur IS NOT NULL AND lr IS NULL AS parent_lifted, is_enhancement, family FROM pk)
"""


_SHORT_DENSE = f"""{_ROUTE_DENSE}, {_SHORT[len(_ROUTE) + 1 : _SHORT.index("pool AS (")].lstrip(",").strip()}
{_near("dx0", "SELECT clause_id AS k FROM leaf", "SELECT control_id AS k FROM ctl", "JOIN ctl c ON c.control_id = i.k JOIN routes r ON r.query = q.k AND r.item = c.family")},
dx AS (SELECT * FROM dx0 WHERE rank <= {5 * PLACES}),
{_fused("pool", "lx", "dx")},
{_SHORT[_SHORT.index("lift0 AS (") : _SHORT.index("fs AS (SELECT coalesce")]}
{_fused("fq", "lx", "dx", "lift")},
fr AS (SELECT fq.* EXCLUDE (rank), is_enhancement, family, rank AS pos FROM fq JOIN ctl ON control_id = item),
{_SHORT[_SHORT.index("kk AS (SELECT") : _SHORT.index("short AS (SELECT query")]}
short AS (SELECT query, item AS control_id, score, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank, r0 AS bm25_rank, r1 AS dense_rank, r2 IS NOT NULL AND r0 IS NULL AND r1 IS NULL AS parent_lifted, is_enhancement, family FROM pk)
"""


def _recall(ranks: str, want: str, ks: str) -> str:
    return f"""first AS (SELECT w.query, min(r.rank) AS first FROM ({want}) w LEFT JOIN {ranks} r ON r.query = w.query AND r.item = w.item GROUP BY 1)
SELECT k, count(*) AS n_groups, count(*) FILTER (first <= k) AS n_hit, round(count(*) FILTER (first <= k) / count(*), 6) AS recall FROM first, (SELECT unnest([{ks}]) AS k) GROUP BY k"""


ORDER_SQL = "list_aggregate(list_transform(string_split(path, '.'), lambda m: CASE WHEN regexp_full_match(m, '[0-9]+') THEN lpad(m, 6, '0') ELSE m END), 'string_agg', '.')"


def queries() -> dict:
    names = "token_stats term_idf bm25_topk dense_topk dense_recall dense_cells_recall rrf_fusion hybrid_filtered answered profiles routes routes_dense routes_single routes_complete route_frequency route_funnel route_recall route_recall_areas shortlists shortlists_dense shortlist_stats shortlist_reach most_shortlisted never_shortlisted shortlist_recall shortlist_hits clause_children clause_ancestors inherited_modal clause_full_text routing_text"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    tree = f"WITH RECURSIVE {_CLA}, {_ANC}"
    return {
        "token_stats": f"WITH {_CTL}, t AS (SELECT control_id, {_tok(_TEXT)} AS t FROM ctl) SELECT control_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM t",
        "term_idf": f"WITH {_CTL}, t AS (SELECT control_id, unnest(list_distinct({_tok(_TEXT)})) AS term FROM ctl), n AS (SELECT count(*) AS n FROM ctl) SELECT term, count(*) AS df, round(greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1.0), 1e-6), 6) AS idf FROM t, n GROUP BY term",
        "bm25_topk": f"WITH RECURSIVE {_CTL}, {_CLA}, {_ANC}, {_LEAF}, {_bm25(_IDX, 'SELECT clause_id AS query, asked AS t FROM leaf', 's')} SELECT query AS clause_id, item AS control_id, score, {_RANK} AS rank FROM s QUALIFY rank <= {PLACES}",
        "dense_topk": f"SELECT *, {_RANK} AS rank FROM ({_DENSE}) QUALIFY rank <= 10",
        "dense_recall": f"""WITH t AS (SELECT *, {_RANK} AS rank FROM ({_DENSE}) QUALIFY rank <= 10),
first AS (SELECT query, min(CASE WHEN a.label = b.label THEN rank - 1 END) AS first FROM t JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = item WHERE query <> item GROUP BY 1)
SELECT k, count(*) AS n_queries, count(*) FILTER (first <= k) AS n_hit, round(count(*) FILTER (first <= k) / count(*), 6) AS recall FROM first, (SELECT unnest([1, 3, 5]) AS k) GROUP BY k""",
        "rrf_fusion": f"{_DOCS} SELECT query, item, score, rank, CASE WHEN lr IS NOT NULL AND dr IS NOT NULL THEN 'both' WHEN lr IS NOT NULL THEN 'bm25' ELSE 'dense' END AS found_by FROM f",
        "hybrid_filtered": f"{_DOCS} SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY rank) AS place, status, source, lr AS bm25_rank, dr AS dense_rank FROM f JOIN documents ON doc_id = item WHERE status = 'binding' QUALIFY place <= 8",
        "answered": f"""{_DOCS}, h AS (SELECT query FROM f JOIN documents ON doc_id = item WHERE status = 'draft' QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 8)
SELECT doc_id AS query, count(h.query) AS n_hits, CASE WHEN count(h.query) = 0 THEN 'Nothing in the corpus answers this.' ELSE '' END AS answer FROM documents LEFT JOIN h ON h.query = doc_id WHERE doc_id % 20 = 0 AND title_en IS NOT NULL GROUP BY 1""",
        "profiles": f"WITH {_CTL}, {_PROF} SELECT * FROM prof",
        "routes": f"{_ROUTE} SELECT query AS clause_id, item AS family, score, rank FROM routes",
        "route_frequency": f"{_ROUTE}, n AS (SELECT family, count(query) AS n FROM (SELECT DISTINCT family FROM ctl) LEFT JOIN routes ON item = family GROUP BY 1) SELECT family, n, CASE WHEN n > 0 THEN repeat('#', greatest(1, n * 40 // (SELECT max(n) FROM n))) ELSE '' END AS bar FROM n",
        "route_funnel": f"{_ROUTE}, x AS (SELECT (SELECT count(*) FROM leaf) AS n_clauses, (SELECT count(*) FROM ctl) AS n_controls, (SELECT count(*) FROM routes JOIN ctl ON family = item) AS pairs_routed) SELECT n_clauses, n_controls, n_clauses * n_controls AS pairs_full, pairs_routed, 100 - 100 * pairs_routed // (n_clauses * n_controls) AS reduction FROM x",
        "route_recall": f"{_ROUTE}, {_WANT}, {_recall('routes', 'SELECT query, item FROM wf', '1, 2, 3, 5')}",
        "route_recall_areas": f"""{_ROUTE}, {_WANT}, h AS (SELECT w.query, any_value(w.area) AS area, min(r.rank) AS first FROM wf w LEFT JOIN routes r ON r.query = w.query AND r.item = w.item GROUP BY 1)
SELECT area, count(*) AS n, count(*) FILTER (first <= 3) AS n_hit, round(count(*) FILTER (first <= 3) / count(*), 6) AS recall, count(*) FILTER (first <= 3) / count(*) < 0.6 AS weak FROM h GROUP BY 1""",
        "routes_dense": f"{_ROUTE_DENSE} SELECT query AS clause_id, item AS family, score, rank FROM routes",
        "routes_single": f"{_ROUTE[: _ROUTE.index("g AS (SELECT query")].rstrip().rstrip(",")} SELECT query AS area, item AS family, score, rank FROM (SELECT *, {_RANK} AS rank FROM pri) WHERE rank <= 3",
        "routes_complete": f"{_ROUTE}, m AS (SELECT clause_id, clause_id NOT IN (SELECT query FROM routes) AS miss FROM leaf) SELECT count(*) AS n_targets, count(*) FILTER (miss) AS n_missing, count(*) FILTER (miss) = 0 AS complete FROM m",
        "shortlists_dense": f"{_SHORT_DENSE} SELECT query AS clause_id, control_id, score, rank, bm25_rank, dense_rank, parent_lifted, is_enhancement FROM short",
        "shortlist_reach": f"{_SHORT} SELECT *, (100 * n_enhancements // greatest(n_pairs, 1))::BIGINT AS enhancement_percent, round(n_reached / n_controls, 6) AS reach FROM (SELECT count(DISTINCT query) AS n_shortlists, count(*) AS n_pairs, count(*) FILTER (is_enhancement) AS n_enhancements, count(DISTINCT control_id) AS n_reached FROM short), (SELECT count(*) AS n_controls FROM ctl)",
        "most_shortlisted": f"{_SHORT} SELECT control_id, count(*) AS n FROM short GROUP BY 1 ORDER BY n DESC, control_id LIMIT 10",
        "shortlist_hits": f"{_SHORT}, {_WANT}, w AS (SELECT DISTINCT query, control_id AS item FROM want WHERE query IN (SELECT query FROM short)) SELECT w.query AS clause_id, string_agg(DISTINCT w.item, ',' ORDER BY w.item) AS wanted, min(s.rank) AS first FROM w LEFT JOIN short s ON s.query = w.query AND s.control_id = w.item GROUP BY 1",
        "shortlists": f"{_SHORT} SELECT query AS clause_id, control_id, score, rank, bm25_rank, parent_lifted, is_enhancement FROM short",
        "shortlist_stats": f"""{_SHORT} SELECT c.family, any_value(n) AS n_controls, count(s.query) AS n_pairs, count(*) FILTER (s.is_enhancement) AS n_enhancements, count(*) FILTER (s.parent_lifted) AS n_lifted,
  count(DISTINCT s.control_id) AS n_reached, any_value(n) - count(DISTINCT s.control_id) AS n_never FROM (SELECT family, count(*) AS n FROM ctl GROUP BY 1) c LEFT JOIN short s ON s.family = c.family GROUP BY 1""",
        "never_shortlisted": f"{_SHORT} SELECT control_id, family FROM ctl WHERE control_id NOT IN (SELECT control_id FROM short)",
        "shortlist_recall": f"{_SHORT}, {_WANT}, sr AS (SELECT query, control_id AS item, rank FROM short), {_recall('sr', 'SELECT DISTINCT query, control_id AS item FROM want WHERE query IN (SELECT query FROM short)', '3, 5, 10')}",
        "clause_children": f"WITH {_CLA}, k AS (SELECT parent_id, count(*) AS n, string_agg(clause_id, '|' ORDER BY {ORDER_SQL}, clause_id) AS ids FROM cla WHERE parent_id IS NOT NULL GROUP BY 1) SELECT clause_id, coalesce(n, 0) AS n_children, coalesce(ids, '') AS child_ids FROM cla LEFT JOIN k ON k.parent_id = clause_id",
        "clause_ancestors": f"{tree} SELECT node AS clause_id, ancestor, distance FROM anc",
        "inherited_modal": f"""{tree}, v AS (SELECT node, min_by(deontic, distance) FILTER (deontic IS NOT NULL) AS v FROM anc JOIN cla ON clause_id = ancestor GROUP BY 1)
SELECT clause_id, deontic AS deontic_own, coalesce(deontic, v) AS deontic, deontic IS NULL AND node IS NOT NULL AS inherited FROM cla LEFT JOIN v ON node = clause_id""",
        "clause_full_text": f"{tree}, b AS (SELECT node, ancestor FROM anc UNION ALL SELECT clause_id, clause_id FROM cla) SELECT ancestor AS clause_id, string_agg(text, ' ' ORDER BY {ORDER_SQL}, clause_id) AS full_text FROM b JOIN cla ON clause_id = node GROUP BY 1",
        "routing_text": f"{tree}, {_LEAF} SELECT clause_id, context, asked FROM leaf",
    }
