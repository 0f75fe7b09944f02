"""Dense ranking and reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from alinea.operators.lexical import PLACES, ranked
from alinea.plans.skew import checked_broadcast, skew_join
from alinea.plans.stage import staged
from alinea.plans.unions import union_all

RRF_K = 60


def embed(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "") -> DataFrame:
    """``key, vector``: unit vectors of texts by a model that ``encoder`` loads once in each task; queries may need a ``prefix``.

    Batches go to the model whole. A null text is encoded as an empty one; a zero vector stays zero.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            v = np.asarray(encode([prefix + (t or "") for t in pdf[text]]), dtype=np.float32)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({key: pdf[key], "vector": list(v / np.where(size == 0, 1, size))})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, vector array<float>")


#: Vectors of a block on either side of a dense product.
BLOCK = 2048


def _blocks(df: DataFrame, key: str, vector: str, name: str, by: list[str] | None = None) -> tuple[DataFrame, int]:
    """``df`` as rows of about ``BLOCK`` keys and vectors each, dealt by hash (within groups of ``by``), and the number of hashes."""
    n = df.count() // BLOCK + 1
    dealt = df.where(F.col(vector).isNotNull()).groupBy(*(by or []), F.pmod(F.xxhash64(key), F.lit(n)).alias("_b"))
    return dealt.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias(name)), n


def _products(pairs: DataFrame, k: int, q_type: str, i_type: str) -> DataFrame:
    """The best ``k`` items (and their ties) of each query in each pair of blocks ``q`` and ``i``: one matrix product each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = (np.array([x["v"] for x in side], dtype=float) for side in (r.q, r.i))
                scores = np.round(a @ b.T, PLACES)
                names = np.array([x["k"] for x in r.i])
                at = [np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k]) for row in scores]
                yield pd.DataFrame({"query": np.repeat([x["k"] for x in r.q], [len(x) for x in at]), "item": names[np.concatenate(at)], "score": np.concatenate([row[x] for row, x in zip(scores, at)])})

    return pairs.select("q", "i").mapInPandas(run, f"query {q_type}, item {i_type}, score double")


def dense_top(queries: DataFrame, query: str, items: DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """``query, item, score, rank``: the ``k`` items with the highest inner product for each query (ties by item).

    A stated query set against all rows, in blocks: the blocks of queries go to every block of items, which comes to
    their tasks whole where it is counted small; only the best ``k`` items of each query and block go on. Exact. Null vectors are left out.
    """
    q_type, i_type = dict(queries.dtypes)[query], dict(items.dtypes)[item]
    i, n = _blocks(items, item, vector, "i")
    q, _ = _blocks(queries, query, vector, "q")
    everywhere = q.drop("_b").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    # The hint: Spark takes the repeated blocks for as small as one copy of each and might broadcast them.
    return ranked(_products(everywhere.hint("merge").join(checked_broadcast(staged(i, "blocks"), n), "_b"), k, q_type, i_type), k)


class Cells(NamedTuple):
    """A coarse partition of vectors: the centres of its cells."""

    centres: np.ndarray

    @classmethod
    def fit(cls, items: DataFrame, vector: str, cells: int = 64, sample: int = 20_000, rounds: int = 10, seed: int = 17) -> Cells:
        """Centres by k-means of at most ``sample`` vectors, those with the lowest hashes of their values, on the driver.

        Only the centres depend on the sample; every vector is indexed. Fewer vectors than ``cells`` give fewer cells.
        """
        held = items.where(F.col(vector).isNotNull())
        share = min(1.0, 1.2 * sample / max(1, held.count()))
        part = F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
        v = np.array([r[0] for r in held.where(part < share).select(vector).limit(sample).collect()], dtype=float)  # bounded by ``sample``
        if not len(v):
            return cls(np.zeros((1, 1)))
        v = v[np.lexsort(v.T)]
        centres = v[np.random.default_rng(seed).choice(len(v), min(cells, len(v)), replace=False)]
        for _ in range(rounds):
            near = np.argmax(v @ centres.T - (centres**2).sum(1) / 2, axis=1)
            centres = np.array([v[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return cls(centres)

    def assign(self, df: DataFrame, key: str, vector: str, cells: int) -> DataFrame:
        """``key, vector, cell`` for each of the ``cells`` nearest cells of a row."""
        centres = self.centres

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v = np.array(pdf[vector].tolist(), dtype=float)
                if len(v):
                    near = np.argsort(-(v @ centres.T - (centres**2).sum(1) / 2), axis=1, kind="stable")[:, :cells]
                    at = np.repeat(np.arange(len(v)), near.shape[1])
                    yield pd.DataFrame({key: pdf[key].to_numpy()[at], vector: [pdf[vector].iloc[i] for i in at], "cell": near.ravel().astype("int32")})

        kinds = dict(df.dtypes)
        return df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, cell int")


def dense_top_in_groups(queries: DataFrame, query: str, items: DataFrame, item: str, vector: str, group: str, k: int) -> DataFrame:
    """``dense_top`` among the items of each query's groups; ``queries`` has a row for each query and group, ``items`` one for each item.

    Groups are cut into blocks, and the blocks of a large group are dealt over tasks.
    """
    q_type, i_type = dict(queries.dtypes)[query], dict(items.dtypes)[item]
    i, _ = _blocks(items, item, vector, "i", [group])
    q, _ = _blocks(queries, query, vector, "q", [group])
    pairs = skew_join(staged(i, "blocks"), q.drop("_b"), [group], "inner", None, 64)
    return ranked(_products(pairs, k, q_type, i_type), k)


def dense_top_in_cells(queries: DataFrame, query: str, items: DataFrame, item: str, vector: str, k: int, cells: Cells, probes: int = 8) -> DataFrame:
    """``dense_top`` among the items in each query's ``probes`` nearest cells: not exact, but a query meets only a part of the items. Every vector is in a cell."""
    near = staged(cells.assign(items, item, vector, 1), "cells")
    return dense_top_in_groups(staged(cells.assign(queries, query, vector, probes), "probes"), query, near, item, vector, "cell", k)


def rrf(*lists: DataFrame) -> DataFrame:
    """Ranked lists (query, item, rank) fused by position: ``query, item, score, rank, list_ranks``.

    A list adds 1 / (60 + rank). Among equal scores the first list's order goes first, then the second's and so on.
    ``list_ranks`` has the item's rank in each list, null where it is absent. One shuffle, whatever the number of lists.
    """
    n = len(lists)
    each = union_all([x.select("query", "item", F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)])
    ranks = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"_r{i}") for i in range(n)]
    fused = each.groupBy("query", "item").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("exact"), *ranks)
    fused = fused.withColumn("score", F.round("exact", PLACES)).withColumn("list_ranks", F.array(*[f"_r{i}" for i in range(n)]))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), *[F.col(f"_r{i}").asc_nulls_last() for i in range(n)], "item")
    return fused.select("query", "item", "score", F.row_number().over(w).alias("rank"), "list_ranks")


def provenance(lexical: Column, dense: Column) -> Column:
    """Which list an item came from: both, bm25 or dense."""
    return F.when(lexical.isNotNull() & dense.isNotNull(), "both").when(lexical.isNotNull(), "bm25").when(dense.isNotNull(), "dense")


def hybrid_search(lexical: DataFrame, dense: DataFrame, items: DataFrame, item: str, k: int = 8, where: Column | None = None) -> DataFrame:
    """Fused pools with the items' columns; ``where`` filters after the pools were cut, then the best ``k`` are kept.

    The filter stays above the pools' windows: fewer than ``k`` rows may come out though more items would match.
    """
    fused = rrf(lexical, dense).withColumnRenamed("item", item)
    met = fused.join(items, item)
    met = met if where is None else met.where(where)
    w = Window.partitionBy("query").orderBy("rank")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*[c for c in met.columns if c != "list_ranks"], "place", F.col("list_ranks")[0].alias("bm25_rank"), F.col("list_ranks")[1].alias("dense_rank"))


def answers(queries: DataFrame, query: str, hits: DataFrame, refusal: str = "Nothing in the corpus answers this.") -> DataFrame:
    """``query, n_hits, answer`` for every query: how many of ``hits`` (query) it has, and the refusal where there is none."""
    n = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"))
    out = queries.select(F.col(query).alias("query")).join(n, "query", "left").select("query", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    return out.withColumn("answer", F.when(F.col("n_hits") == 0, refusal).otherwise(""))
