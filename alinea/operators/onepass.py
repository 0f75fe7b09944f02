"""Routes and shortlists in one pass over the queries, where the targets are few enough to be at hand in every task.

The rules are those of ``routing.route`` and ``routing.shortlist``, but a query's scored pairs never leave its task: only
its shortlist does. Targets (items) are in the order of their keys, so that a lower number is a smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from alinea.operators.fusion import RRF_K
from alinea.operators.lexical import PLACES

#: Targets that a task holds at most; scores of a chunk of queries; dense ranks of a router.
FEW_TARGETS, CHUNK_SCORES, ROUTED = 20_000, 100_000, 1000


class Impacts:
    """An index of BM25 impacts (term, item, impact) as arrays: postings by term."""

    def __init__(self, index: pa.Table, items: list[str]):
        terms = index["term"].combine_chunks().dictionary_encode()
        place = pc.fill_null(pc.index_in(index["item"].combine_chunks(), pa.array(items, index["item"].type)), -1).to_numpy(zero_copy_only=False)
        codes = terms.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        order = order[place[order] >= 0]
        self.n, self.terms, self.place, self.impact = len(items), terms.dictionary, place[order], index["impact"].to_numpy()[order]
        self.start = np.searchsorted(codes[order], np.arange(len(self.terms) + 1))

    def scores(self, tokens: pa.ListArray) -> np.ndarray:
        """Scores of all items for each list of tokens; a repeated token counts each time."""
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        codes = pc.fill_null(pc.index_in(tokens.flatten(), self.terms), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(tokens)), lengths)[codes >= 0]
        codes = codes[codes >= 0]
        many = self.start[codes + 1] - self.start[codes]
        at = np.arange(many.sum()) + np.repeat(self.start[codes] - (np.cumsum(many) - many), many)
        sums = np.bincount(np.repeat(row, many) * self.n + self.place[at], self.impact[at], len(tokens) * self.n)
        return np.round(sums.reshape(len(tokens), self.n), PLACES)


class Vectors:
    """The items' vectors; null ones take no part."""

    def __init__(self, vectors: list):
        self.there = np.array([v is not None for v in vectors], dtype=bool)
        size = next((len(v) for v in vectors if v is not None), 1)
        self.all = np.array([v if v is not None else [0.0] * size for v in vectors], dtype=float).reshape(len(vectors), size)

    def scores(self, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with all items for each vector, and which of them count."""
        has = vectors.is_valid().to_numpy(zero_copy_only=False)
        own = np.zeros((len(vectors), self.all.shape[1]))
        if has.any():
            own[has] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(has.sum(), -1)
        return np.round(own @ self.all.T, PLACES), has[:, None] & self.there[None, :]


def ranks(scores: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Places (from 1) of the best ``k`` that count in each row, ties by number; infinite for the others."""
    order = np.argsort(np.where(counts, -scores, np.inf), axis=1, kind="stable")[:, :k]
    out = np.full(scores.shape, np.inf)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(1.0, order.shape[1] + 1), order.shape), 1)
    out[~counts] = np.inf
    return out


def numbered(row: np.ndarray, col: np.ndarray, shape: tuple[int, int], *order: np.ndarray) -> np.ndarray:
    """Places (from 1) of the entries (row, col) of each row, the first of ``order`` deciding first, then number; infinite elsewhere."""
    by = np.lexsort((col, *reversed(order), row))
    out = np.full(shape, np.inf)
    at = row[by]
    out[at, col[by]] = np.arange(len(at)) - np.searchsorted(at, at) + 1
    return out


def fused(*lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places by reciprocal rank, as ``fusion.rrf`` has them: ties by the first list, the second and so on, then number."""
    scores = np.floor(sum(1.0 / (RRF_K + x) for x in lists) * 10**PLACES + 0.5) / 10**PLACES  # halves up, as Spark and SQL round
    row, col = np.nonzero(np.isfinite(np.minimum.reduce(lists)))
    return scores, numbered(row, col, scores.shape, -scores[row, col], *[x[row, col] for x in lists])


class Router:
    """Families by text and vectors."""

    def __init__(self, families: list[str], impacts: Impacts, vectors: Vectors):
        self.families, self.impacts, self.vectors = families, impacts, vectors

    def lists(self, tokens: pa.ListArray, vectors: pa.ListArray) -> list[np.ndarray]:
        text = self.impacts.scores(tokens)
        return [ranks(text, text > 0, len(self.families)), ranks(*self.vectors.scores(vectors), ROUTED)]

    def priors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``area, prior`` from ``area, title`` (tokens) and ``embedding``: each family's place in the area's fused lists, null for none."""
        for batch in batches:
            if batch.num_rows:
                place = fused(*self.lists(batch.column("title"), batch.column("embedding")))[1]
                flat = pa.array(np.where(np.isfinite(place), place, 0).ravel().astype("int32"), mask=~np.isfinite(place).ravel())
                yield pa.record_batch([batch.column("area"), pa.ListArray.from_arrays(np.arange(0, place.size + 1, len(self.families), dtype="int32"), flat)], names=["area", "prior"])

    def chosen(self, tokens: pa.ListArray, vectors: pa.ListArray, prior: pa.ListArray, k: int) -> np.ndarray:
        """Which families each query goes to: its own lists fused with that of its area, the best ``k``."""
        of_area = np.full((len(tokens), len(self.families)), np.inf)
        has = prior.is_valid().to_numpy(zero_copy_only=False)
        if has.any():
            of_area[has] = pc.fill_null(pc.cast(prior.flatten(), pa.float64()), np.inf).to_numpy(zero_copy_only=False).reshape(has.sum(), -1)
        return fused(*self.lists(tokens, vectors), of_area)[1] <= k


class Shortlister:
    """Shortlists of targets within the families that a query goes to."""

    SCHEMA = "clause_id string, control_id string, score double, rank int, bm25_rank int, dense_rank int, parent_lifted boolean, is_enhancement boolean"

    def __init__(self, router: Router | None, keys: list[str], families: list[str], enhancements: list[bool], parents: list[str | None], impacts: Impacts | None, vectors: Vectors | None, n: int, base_quota: float = 0.7, routed: int = 5):
        self.router, self.impacts, self.vectors, self.n, self.routed = router, impacts, vectors, n, routed
        self.keys, self.enhancement = pa.array(keys, pa.string()), np.array(enhancements, dtype=bool)
        known, family_at = {x: i for i, x in enumerate(keys)}, {x: i for i, x in enumerate(router.families if router else sorted(set(families)))}
        self.family = np.array([family_at[x] for x in families], dtype=int)
        self.parent = np.array([known.get(p, -1) if e and p is not None else -1 for e, p in zip(enhancements, parents)], dtype=int)
        self.n_base = max(1, round(n * base_quota))

    def pick(self, text: np.ndarray, dense: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, score, place, places in either list and whether it was lifted, of scores by text and vectors (those that ``counts`` names) within ``allowed``."""
        first, second = ranks(text, allowed & (text > 0), 5 * self.n), ranks(dense, allowed & counts, 5 * self.n)
        pool = fused(first, second)[1]
        row, col = np.nonzero(np.isfinite(pool) & (self.parent >= 0)[None, :])
        up, at = self.parent[col], pool[row, col]
        inside = allowed[row, up]
        best = np.full(pool.shape, np.inf)
        np.minimum.at(best, (row[inside], up[inside]), at[inside])
        row, col = np.nonzero(np.isfinite(best))
        third = numbered(row, col, pool.shape, best[row, col])
        scores, place = fused(first, second, third)
        row, col = np.nonzero(np.isfinite(place))
        rank, more = place[row, col], self.enhancement[col]
        kth = np.where(more, numbered(row[more], col[more], place.shape, rank[more])[row, col], numbered(row[~more], col[~more], place.shape, rank[~more])[row, col])
        late = kth > np.where(more, self.n - self.n_base, self.n_base)
        keep = numbered(row, col, place.shape, late, rank)[row, col] <= self.n
        row, col = row[keep], col[keep]
        final = numbered(row, col, place.shape, place[row, col])[row, col]
        a, b = first[row, col], second[row, col]
        return row, col, scores[row, col], final, a, b, np.isfinite(third[row, col]) & np.isinf(a) & np.isinf(b)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``SCHEMA`` from ``clause_id, context, asked`` (tokens), ``prior`` and ``embedding``."""
        chunk = max(1, CHUNK_SCORES // max(1, len(self.keys)))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                vectors = part.column("embedding")
                chosen = self.router.chosen(part.column("context"), vectors, part.column("prior"), self.routed)
                row, col, score, place, a, b, lifted = self.pick(self.impacts.scores(part.column("asked")), *self.vectors.scores(vectors), chosen[:, self.family])
                whole = lambda x: pa.array(np.where(np.isfinite(x), x, 0).astype("int32"), mask=~np.isfinite(x))
                columns = [part.column("clause_id").take(pa.array(row)), self.keys.take(pa.array(col)), pa.array(score), whole(place), whole(a), whole(b), pa.array(lifted), pa.array(self.enhancement[col])]
                yield pa.record_batch(columns, names=[x.split()[0] for x in self.SCHEMA.split(", ")])
