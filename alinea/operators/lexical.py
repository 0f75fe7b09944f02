"""Inverted index and BM25 ranking as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from alinea.functions.text import tokens
from alinea.plans.skew import HOT_ROWS, is_small, skew_join
from alinea.plans.stage import staged

K1, B, IDF_FLOOR = 1.5, 0.75, 1e-6
#: Decimal places that scores are ranked at, so that sums in another order rank alike.
PLACES = 6


def postings(items: DataFrame, item: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """``term, item, tf, dl``: how often a term is in an item, and the item's number of tokens; of the terms in ``only`` (term, small), if given."""
    each = items.select(F.col(item).alias("item"), tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))
    # explode_outer: for explode, Spark puts a filter below that finds every text's tokens once more.
    said = each.select("item", "dl", F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
    said = said if only is None else said.join(F.broadcast(only), "term", "left_semi")
    return said.groupBy("term", "item").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def term_stats(posts: DataFrame, items: DataFrame) -> DataFrame:
    """``term, df, idf`` over all items, those without tokens included. The number of items comes by a one-row join."""
    n = items.agg(F.count(F.lit(1)).alias("n"))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), F.lit(IDF_FLOOR))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf.alias("idf"))  # one row: no growth


def impacts(items: DataFrame, item: str, text: str, hot_rows: int = HOT_ROWS, asked: DataFrame | None = None) -> DataFrame:
    """``term, item, impact``: what one occurrence of a term in a query adds to the item's BM25 score.

    Postings are made once and staged. Their join with the terms' weights is salted for terms that stand in more than
    ``hot_rows`` items, which their counted document frequencies name. ``asked`` (term, a staged table) names the terms
    that queries have: where it is counted small, others get no postings; the weights and lengths are those of whole items.
    """
    each = items.select(F.col(item).alias("item"), tokens(text).alias("tokens"))
    stats = each.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean_dl"))
    small = asked is not None and is_small(asked, asked.count())
    posts = staged(postings(items, item, text, asked if small else None), "postings")
    df = staged(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    hot = staged(df.where(F.col("df") > hot_rows).select("term", F.ceil(F.col("df") / hot_rows).cast("int").alias("_slices")), "hot")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), F.lit(IDF_FLOOR))
    w = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    met = skew_join(posts, df, ["term"], "inner", None, hot_rows, (hot, hot.count()))
    return met.crossJoin(F.broadcast(stats)).select("term", "item", w.alias("impact"))  # stats: one row


def bm25_scores(queries: DataFrame, query: str, text: str, index: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``query, item, score`` for all pairs that share a term; repeated query terms count each time.

    Terms of a query are counted before the join, so a term's postings meet each query once; the postings of terms with
    more than ``hot_rows`` are dealt over several tasks.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(text)).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    met = skew_join(index.select("term", "item", "impact"), asked, ["term"], "inner", None, hot_rows)
    return met.groupBy("query", "item").agg(F.round(F.sum(F.col("qtf") * F.col("impact")), PLACES).alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """``query, item, score, rank`` (1 for the highest, ties by item), positive scores only, the first ``k`` if given."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "item")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


#: Postings of a block of the index, and queries of a block; postings (of about 60 bytes in memory) of an index that is broadcast.
BLOCK_POSTINGS, BLOCK_QUERIES, BROADCAST_POSTINGS = 200_000, 1024, 400_000


class _Block:
    """A block of the index as arrays: postings by term, items by number."""

    def __init__(self, rows: pa.StructArray):
        names = [f.name for f in rows.type]
        terms, items = (pc.dictionary_encode(rows.field(names.index(n))) for n in ("term", "item"))
        codes = terms.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        self.terms, self.items = terms.dictionary, items.dictionary
        self.place = items.indices.to_numpy()[order]
        self.impact = rows.field(names.index("impact")).to_numpy()[order]
        self.start = np.searchsorted(codes[order], np.arange(len(self.terms) + 1))
        self.groups: dict[str, np.ndarray] = {}
        if "group" in names:
            of = np.empty(len(self.items), dtype=object)
            of[items.indices.to_numpy()] = rows.field(names.index("group")).to_numpy(zero_copy_only=False)
            self.groups = {g: of == g for g in set(of)}

    def top(self, codes: np.ndarray, allowed: list[str] | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the best ``k`` items and their ties for a query's terms (codes, -1 unknown)."""
        scores = np.zeros(len(self.items))
        for c in codes:
            if c >= 0:
                a, z = self.start[c], self.start[c + 1]
                scores[self.place[a:z]] += self.impact[a:z]  # an item is in a term's postings once
        if allowed is not None:
            inside = np.zeros(len(scores), bool)
            for g in allowed:
                inside |= self.groups.get(g, False)
            scores[~inside] = 0
        scores = np.round(scores, PLACES)
        there = np.flatnonzero(scores > 0)
        if len(there) > k:
            there = there[scores[there] >= np.partition(scores[there], -k)[-k]]
        return there, scores[there]


def _top_in_blocks(queries: DataFrame, query: str, text: str, index: DataFrame, k: int, groups: str | None) -> DataFrame:
    """The best ``k`` items and their ties of each query in each block of the index; the queries come in blocks, too."""
    q_type, i_type = dict(queries.dtypes)[query], dict(index.dtypes)["item"]
    n = index.count()
    posts, asked = n // BLOCK_POSTINGS + 1, queries.count() // BLOCK_QUERIES + 1
    blocks = index.groupBy(F.pmod(F.xxhash64("item"), F.lit(posts)).alias("block")).agg(F.collect_list(F.struct(*index.columns)).alias("posts"))
    allowed = F.col(groups) if groups else F.lit(None).cast("array<string>")
    each = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("query"), tokens(text).alias("tokens"), allowed.alias("allowed"))
    sets = each.groupBy(F.pmod(F.xxhash64("query"), F.lit(asked)).alias("set")).agg(F.collect_list(F.struct("query", "tokens", "allowed")).alias("queries")).drop("set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, _Block] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                number = batch.column("block")[at].as_py()
                if held is None or held[0] != number:
                    held = (number, _Block(batch.column("posts").slice(at, 1).flatten()))
                block = held[1]
                rows = batch.column("queries").slice(at, 1).flatten()
                names, words, limits = (rows.field(i) for i in range(3))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(int)
                codes = pc.fill_null(pc.index_in(words.flatten(), block.terms), -1).to_numpy(zero_copy_only=False)
                limits = limits.to_pylist()
                found = [block.top(codes[ends[i] : ends[i + 1]], limits[i], k) for i in range(len(rows))]
                which = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
                items = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
                scores = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
                yield pa.record_batch([names.take(pa.array(which)), block.items.take(pa.array(items)), pa.array(scores)], names=["query", "item", "score"])

    # A stated set of queries against all items: the query blocks go to every block of the index, which comes to their
    # tasks whole where its counted postings are few; else every block goes to one task, once. The repeated query blocks
    # are never broadcast: Spark takes them for as small as the file of one copy of each, which the hint keeps out.
    everywhere = staged(sets, "query-blocks").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(posts - 1).cast("bigint"))))
    spread = everywhere.repartition(min(asked * posts, 4 * queries.sparkSession.sparkContext.defaultParallelism))
    whole = staged(blocks, "index-blocks")
    pairs = spread.hint("merge").join(F.broadcast(whole) if n <= BROADCAST_POSTINGS else whole, "block").select("block", "posts", "queries")
    return pairs.mapInArrow(run, f"query {q_type}, item {i_type}, score double")


def bm25_top(queries: DataFrame, query: str, text: str, index: DataFrame, k: int | None = None, groups: str | None = None) -> DataFrame:
    """The best ``k`` items of each query by BM25, all with a shared term if ``k`` is null; none for queries without one.

    For a bounded ``k``, blocks of queries meet blocks of the index (``impacts``), and only the best ``k`` of a query and
    block go on; without it all scored pairs are made. ``groups`` names a column of the queries with the groups (a
    column ``group`` of the index) that they are limited to; weights still come from all items. Queries are keyed
    uniquely.
    """
    if k is None:
        return ranked(bm25_scores(queries, query, text, index).where("score > 0"))
    return ranked(_top_in_blocks(queries, query, text, index, k, groups), k)
