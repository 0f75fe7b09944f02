import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from alinea.functions.text import STOP, tokens
from alinea.operators import lexical
from alinea.operators.fusion import Cells, answers, dense_top, dense_top_in_cells, dense_top_in_groups, embed, hybrid_search, provenance, rrf
from alinea.operators.lexical import bm25_top, impacts
from alinea.operators.onepass import Impacts, Shortlister, Vectors, fused
from alinea.operators.routing import area_text, asked_text, family_profiles, focal_text, recall_at, shortlist
from alinea.plans import retrieval
from alinea.plans.stage import staged
from pyspark.sql import functions as F


def test_tokens(spark):
    text = "Per AC-2(3), SA-15(13) and 3.3.12-4.a the multi-factor users' 30 days A b ISO-27001 café"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tokens("t").alias("t")).collect()
    assert got[0].t == ["per", "ac-2(3)", "sa-15(13)", "3.3.12", "multi", "factor", "users'", "days", "iso", "caf"]
    assert got[1].t == got[2].t == []
    assert "the" in STOP


def bm25(corpus, query):
    """Brute force over lists of tokens."""
    n, mean = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    out = {}
    for item, toks in corpus.items():
        tf, score = Counter(toks), 0.0
        for q in query:
            df = sum(q in t for t in corpus.values())
            if tf[q]:
                idf = max(math.log((n - df + 0.5) / (df + 0.5) + 1), 1e-6)
                score += idf * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(toks) / mean))
        if round(score, 6) > 0:
            out[item] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("k", [None, 3])
def test_bm25_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 3)
    rng = random.Random(2)
    words = [f"w{i}x" for i in range(12)]
    corpus = {i: [rng.choice(words) for _ in range(rng.randint(0, 15))] for i in range(30)}
    asked = {f"q{i}": [rng.choice([*words, "none"]) for _ in range(rng.randint(0, 6))] for i in range(8)}
    items = spark.createDataFrame([(i, " ".join(t), "x") for i, t in corpus.items()], "id int, text string, score string")
    queries = spark.createDataFrame([(q, " ".join(t), 0) for q, t in asked.items()] + [("null", None, 0)], "q string, text string, item int")
    got = {}
    for r in bm25_top(queries, "q", "text", impacts(items, "id", "text"), k).collect():
        got.setdefault(r.query, []).append((r.rank, r.item, r.score))
    want = {q: bm25(corpus, t)[:k] for q, t in asked.items()}
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [i for _, i, _ in mine] == [i for i, _ in best]
        assert np.allclose([s for *_, s in mine], [s for _, s in best], atol=2e-6)
    assert "null" not in got


def test_repeated_query_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 20)
    monkeypatch.setattr(lexical, "BROADCAST_POSTINGS", 10)
    items = spark.createDataFrame([(i, f"word{i % 7} word{i % 5}") for i in range(60)], "id int, text string")
    queries = spark.createDataFrame([(f"q{i}", f"word{i}") for i in range(4)], "q string, text string")
    index = impacts(items, "id", "text")
    top = bm25_top(queries, "q", "text", index, 3)
    assert "Broadcast" not in top._jdf.queryExecution().executedPlan().toString()
    assert {(r.query, r.item) for r in top.collect()} == {(r.query, r.item) for r in bm25_top(queries, "q", "text", index).where("rank <= 3").collect()}


def test_postings_of_asked_terms_weigh_as_those_of_all(spark):
    items = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma delta"), (3, ""), (4, None)], "id int, text string")
    asked = staged(spark.createDataFrame([("beta",), ("gamma",), ("none",)], "term string"), "asked")
    every = {(r.term, r.item): r.impact for r in impacts(items, "id", "text").collect()}
    got = {(r.term, r.item): r.impact for r in impacts(items, "id", "text", asked=asked).collect()}
    assert got == {x: w for x, w in every.items() if x[0] in ("beta", "gamma")} and len(got) == 2 and len(every) == 5


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, title_en string, status string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def test_a_title_is_searched_once(spark, tmp_path, monkeypatch):
    searched = []
    plain = retrieval.bm25_top
    monkeypatch.setattr(retrieval, "bm25_top", lambda q, *rest: searched.append((q.count(), rest[2].select("term").distinct().count())) or plain(q, *rest))
    titles = {20: "Key Circular", 40: "Key Circular", 60: "Site", 80: None, 100: ""}
    _documents(spark, tmp_path, [(i, f"key number{i}" if i % 2 else "site", titles.get(i, "Other"), "draft" if i < 50 else "binding", "s") for i in range(1, 101)])
    rows = retrieval.rrf_fusion(spark, str(tmp_path)).collect()
    assert searched == [(3, 2)]  # of the titles "Key Circular", "Site" and "", the terms that are in texts
    by = {q: [r.item for r in sorted(rows, key=lambda r: r.rank) if r.query == q] for q in titles}
    assert by[20] == by[40] == list(range(1, 81, 2)) and by[60] == list(range(2, 82, 2)) and not by[80] and not by[100]
    assert {r["query"]: r.n_hits for r in retrieval.answered(spark, str(tmp_path)).collect()} == {20: 8, 40: 8, 60: 8, 100: 0}
    hits = retrieval.hybrid_filtered(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in hits if r.query == 20) == list(range(51, 67, 2)) and {r.status for r in hits} == {"binding"}


def test_many_titles_best_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("alinea.plans.skew.BROADCAST_ROWS", 10)
    _documents(spark, tmp_path, [(i, f"key number{i % 7}", f"Key Title{i}", "binding" if i % 3 else "draft", "s") for i in range(1, 201)])
    lexical = retrieval._document_lists(spark, str(tmp_path))[1]
    assert "Broadcast" not in lexical._jdf.queryExecution().executedPlan().toString()
    hits = retrieval.hybrid_filtered(spark, str(tmp_path)).collect()
    assert len(hits) == 80 and {r.place for r in hits} == set(range(1, 9)) and {r["query"] for r in hits} == set(range(20, 201, 20))
    assert [r.doc_id for r in sorted(hits, key=lambda r: r.place) if r["query"] == 20] == [1, 2, 4, 5, 7, 8, 10, 11]


def test_groups_limit_a_query(spark):
    items = spark.createDataFrame([(1, "alpha beta", "a"), (2, "alpha", "b"), (3, "alpha gamma", "c")], "id int, text string, g string")
    index = impacts(items, "id", "text").join(items.select(F.col("id").alias("item"), F.col("g").alias("group")), "item")
    q = spark.createDataFrame([("x", "alpha", ["a", "c"]), ("y", "alpha", []), ("z", "alpha", ["unknown"])], "q string, t string, gs array<string>")
    assert sorted((r.query, r.item) for r in bm25_top(q, "q", "t", index, 5, "gs").collect()) == [("x", 1), ("x", 3)]


def test_dense_against_numpy(spark, monkeypatch):
    monkeypatch.setattr("alinea.operators.fusion.BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5)).astype(np.float32)
    v[5] = v[6]
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id int, v array<float>")
    got = {}
    for r in dense_top(e.where("id % 10 = 0"), "id", e, "id", "v", 4).collect():
        got.setdefault(r.query, []).append((r.rank, r.item))
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: sorted(range(40), key=lambda i: (-s[q, i], i))[:4] for q in (0, 10, 20, 30)}


def test_dense_in_groups_and_cells(spark, monkeypatch):
    monkeypatch.setattr("alinea.operators.fusion.BLOCK", 9)
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(6, 4))[np.arange(120) % 6] + 0.1 * rng.normal(size=(120, 4))).astype(np.float32)
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    e = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)] + [(999, None, 0)], "id int, v array<float>, g int")
    asked = e.where("id < 8").select("id", "v", F.explode(F.array(F.lit(0), F.lit(2))).alias("g"))
    got = {}
    for r in dense_top_in_groups(asked, "id", e, "id", "v", "g", 3).collect():
        got.setdefault(r.query, []).append((r.rank, r.item))
    allowed = [i for i in range(120) if i % 3 != 1]
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: sorted(allowed, key=lambda i: (-s[q, i], i))[:3] for q in range(8)}
    cells = Cells.fit(e, "v", 6, sample=60)
    assert len(cells.centres) == 6 and cells.assign(e, "id", "v", 1).count() == 120  # every vector is indexed
    exact = {(r.query, r.item) for r in dense_top(e, "id", e, "id", "v", 5).collect()}
    found = {(r.query, r.item) for r in dense_top_in_cells(e, "id", e, "id", "v", 5, cells, 3).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {(r.query, r.item) for r in dense_top_in_cells(e, "id", e, "id", "v", 5, cells, 6).collect()} == exact  # all cells: exact
    assert dense_top_in_cells(e.limit(0), "id", e, "id", "v", 5, cells, 3).count() == dense_top(e, "id", e.limit(0), "id", "v", 5).count() == 0
    assert len(Cells.fit(e.limit(0), "v").centres) == 1


def test_hot_terms_are_dealt_out_alike(spark):
    items = spark.createDataFrame([(i, "common " + ("rare " if i % 9 == 0 else "") + f"own{i}") for i in range(60)], "id int, text string")
    plain, dealt = ({(r.term, r.item): round(r.impact, 9) for r in impacts(items, "id", "text", hot).collect()} for hot in (250_000, 5))
    assert plain == dealt and len(plain) == 127
    asked = spark.createDataFrame([("q", "common rare common")], "q string, text string")
    a, b = ({(r.item, r.score) for r in lexical.bm25_scores(asked, "q", "text", impacts(items, "id", "text"), hot).collect()} for hot in (250_000, 5))
    assert a == b and len(a) == 60


def test_answers_and_texts(spark):
    q = spark.createDataFrame([("a",), ("b",)], "q string")
    hits = spark.createDataFrame([("a",), ("a",)], "query string")
    assert sorted(map(tuple, answers(q, "q", hits, "no").collect())) == [("a", 2, ""), ("b", 0, "no")]
    df = spark.createDataFrame([("T", "", None, "x")], "t string, p string, u string, x string")
    c = [F.col(n) for n in "tpux"]
    assert tuple(df.select(focal_text(*c), area_text(c[0], F.lit("P"), c[2]), asked_text(c[0], F.lit("up"), c[3]), asked_text(c[0], c[1], c[3], F.lit("r s"), "context"), asked_text(c[0], c[1], c[3], mode="clause")).first()) == ("T x", "T P", "T up x", "T r s x", "x")
    with pytest.raises(ValueError):
        asked_text(*c[:3], mode="other")


def test_embed(spark):
    def encoder():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    df = spark.createDataFrame([(1, "aa", 0), (2, None, 0), (3, "xyz", 0)], "id int, t string, vector int")
    got = {r.id: [round(x, 4) for x in r.vector] for r in embed(df, "id", "t", encoder).collect()}
    assert got == {1: [0.7071, 0.7071], 2: [0.0, 0.0], 3: [1.0, 0.0]}
    assert embed(df, "id", "t", encoder, "a: ").where("id = 2").first().vector[1] > 0


def lists(spark, *ranked):
    return [spark.createDataFrame([("q", i, r) for r, i in enumerate(x, 1)], "query string, item string, rank int") for x in ranked]


def test_rrf_ties_keep_the_first_lists_order(spark):
    a, b = lists(spark, ["x", "y", "s"], ["s", "u", "v"])
    got = rrf(a, b).orderBy("rank").collect()
    assert [r.item for r in got] == ["s", "x", "y", "u", "v"]
    assert got[0].score == round(1 / 63 + 1 / 61, 6) and got[0].list_ranks == [3, 1]
    tags = rrf(a, b).select("item", provenance(F.col("list_ranks")[0], F.col("list_ranks")[1]).alias("p")).collect()
    assert {r.item: r.p for r in tags} == {"s": "both", "x": "bm25", "y": "bm25", "u": "dense", "v": "dense"}


def test_filter_comes_after_the_pool(spark):
    a, b = lists(spark, ["x", "y"], ["y", "x"])
    items = spark.createDataFrame([("x", "no"), ("y", "no"), ("z", "yes")], "id string, status string")
    assert hybrid_search(a, b, items, "id", 8, F.col("status") == "yes").count() == 0
    assert [r.id for r in hybrid_search(a, b, items, "id", 1).collect()] == ["x"]


CONTROLS = "control_id string, family string, family_title string, title string, is_enhancement boolean, parent_id string"


def walk(order, enh, n, quota):
    """The selection as a walk along the fused order."""
    n_base = max(1, round(n * quota))
    base, more, rest = [], [], []
    for x in order:
        (rest if (len(more) >= n - n_base if enh[x] else len(base) >= n_base) else more if enh[x] else base).append(x)
    return sorted([*base, *more, *rest[: max(0, n - len(base) - len(more))]], key=order.index)[:n]


@pytest.mark.parametrize("seed", range(4))
def test_shortlist_quota_against_a_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i:02d}" for i in range(30)]
    enh = {x: rng.random() < 0.7 for x in names}
    targets = spark.createDataFrame([(x, "F", "f", x, enh[x], None) for x in names], CONTROLS)
    order = rng.sample(names, 25)
    scored = spark.createDataFrame([("q", x, float(100 - i)) for i, x in enumerate(order)], "query string, item string, score double")
    routes = spark.createDataFrame([("q", "F")], "query string, family string")
    for n, quota in ((10, 0.7), (5, 0.0), (6, 1.0)):
        got = [r.control_id for r in shortlist(scored, None, targets, routes, n, quota).orderBy("rank").collect()]
        assert got == walk(order[: 5 * n], enh, n, quota)


def test_parent_is_lifted_to_its_best_enhancement(spark):
    rows = [("p", "F", False, None), ("p(1)", "F", True, "p"), ("p(2)", "F", True, "p"), ("o", "F", False, None), ("out", "G", True, "p")]
    targets = spark.createDataFrame([(i, f, "f", i, e, p) for i, f, e, p in rows], CONTROLS)
    scored = spark.createDataFrame([("q", "o", 9.0), ("q", "p(2)", 8.0), ("q", "p(1)", 7.0), ("q", "out", 99.0)], "query string, item string, score double")
    routes = spark.createDataFrame([("q", "F")], "query string, family string")
    got = {r.control_id: r for r in shortlist(scored, None, targets, routes, 10).collect()}
    assert set(got) == {"o", "p", "p(1)", "p(2)"} and got["p"].parent_lifted and got["p"].bm25_rank is None
    dense = spark.createDataFrame([("q", "p", 0.5)], "query string, item string, score double")
    got = {r.control_id: r for r in shortlist(scored, dense, targets, routes, 10).collect()}
    assert not got["p"].parent_lifted and got["p"].dense_rank == 1
    assert shortlist(scored, None, targets, routes.limit(0), 10).count() == 0


def test_one_pass_shortlists_as_the_joined_ones(spark):
    rng = random.Random(7)
    keys = sorted(f"c{i:02d}" for i in range(40))
    family, enh = {x: rng.choice("FGH") for x in keys}, {x: rng.random() < 0.6 for x in keys}
    parent = {x: rng.choice([None, "gone", *keys]) for x in keys}
    targets = spark.createDataFrame([(x, family[x], "f", x, enh[x], parent[x]) for x in keys], CONTROLS)
    go = {f"q{i}": [f for f in "FGH" if rng.random() < 0.7] for i in range(12)}
    text, dense = (np.array([[rng.choice([0, 0, 1, 2, 3]) * rng.choice([0.5, 1.25]) for _ in keys] for _ in go]) for _ in range(2))
    counts = np.array([[rng.random() < 0.8 for _ in keys] for _ in go])
    scored = lambda m, there: spark.createDataFrame([(q, x, float(m[i, j])) for i, q in enumerate(go) for j, x in enumerate(keys) if there[i, j]], "query string, item string, score double")
    routes = spark.createDataFrame([(q, f) for q, fs in go.items() for f in fs], "query string, family string")
    allowed = np.array([[family[x] in fs for x in keys] for fs in go.values()])
    lifted = 0
    for n, quota in ((4, 0.7), (3, 0.0), (5, 1.0)):
        lister = Shortlister(None, keys, [family[x] for x in keys], [enh[x] for x in keys], [parent[x] for x in keys], None, None, n, quota)
        want = {(r.query, r.control_id, r.score, r.rank, r.bm25_rank, r.dense_rank, r.parent_lifted) for r in shortlist(scored(text, text > 0), scored(dense, counts), targets, routes, n, quota).collect()}
        got = {(f"q{r}", keys[i], s, p, *(int(x) if np.isfinite(x) else None for x in (a, b)), up) for r, i, s, p, a, b, up in zip(*(x.tolist() for x in lister.pick(text, dense, counts, allowed)))}
        assert got == want and len(want) > 20
        lifted += sum(x[-1] for x in want)
    assert lifted


def test_one_pass_fusion_rounds_halves_up():
    scores, place = fused(np.array([[68.0, np.inf, np.inf]]), np.array([[np.inf, np.inf, 1.0]]))
    assert scores.tolist() == [[0.007813, 0.0, 0.016393]] and place.tolist() == [[2.0, np.inf, 1.0]]


def test_vectors_and_texts_that_are_missing():
    v = Vectors([[1.0, 0.0], None, [0.0, 2.0]])
    scores, there = v.scores(pa.array([[3.0, 1.0], None], pa.list_(pa.float32())))
    assert scores.tolist() == [[3.0, 0.0, 2.0], [0.0, 0.0, 0.0]] and there.tolist() == [[True, False, True], [False] * 3]
    index = Impacts(pa.table({"term": ["a", "b", "a", "a"], "item": ["x", "y", "y", "out"], "impact": [1.0, 2.0, 0.5, 9.0]}), ["x", "y"])
    assert index.scores(pa.array([["a", "b", "a", "no"], [], None, ["b"]], pa.list_(pa.string()))).tolist() == [[2.0, 3.0], [0.0, 0.0], [0.0, 0.0], [0.0, 2.0]]


def test_shortlists_of_few_targets_make_no_pairs(spark, monkeypatch):
    """Only shortlists leave the tasks: neither routes nor scored pairs are made as rows."""
    def unwanted(*_):
        raise AssertionError("pairs")

    d = "/root/testdata/sf0.001"
    want = {tuple(r) for r in _by_joins(spark, d, monkeypatch)}
    for name in ("_routes_dense", "_shortlist_of"):
        monkeypatch.setattr(retrieval, name, unwanted)
    assert {tuple(r) for r in retrieval.shortlists_dense(spark, d).collect()} == want and len(want) > 1000


def _by_joins(spark, d, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(retrieval, "FEW_TARGETS", 0)
        return retrieval.shortlists_dense(spark, d).collect()


def test_profiles_and_recall(spark):
    c = spark.createDataFrame([("b", "F", "Fam", "Two", False, None), ("a", "F", "Fam", "One", False, None), ("a(1)", "F", "Fam", "Not", True, "a"), ("z(1)", "G", "Gam", "Only", True, None)], CONTROLS)
    got = {r.family: (r.n_base, r.n_total, r.profile) for r in family_profiles(c).collect()}
    assert got == {"F": (2, 3, "Fam. One; Two"), "G": (0, 1, "Gam. ")}
    ranks = spark.createDataFrame([("q", "x", 2), ("r", "y", 1)], "query string, item string, rank int")
    want = spark.createDataFrame([("q", "x"), ("q", "n"), ("r", "n")], "query string, item string")
    assert sorted((r.k, r.n_groups, r.n_hit, r.recall) for r in recall_at(ranks, want, [1, 2]).collect()) == [(1, 2, 0, 0.0), (2, 2, 1, 0.5)]
