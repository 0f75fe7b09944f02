import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from alinea.llm import topn
from alinea.llm.topn import score_code, select_rows, top_n


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), -math.inf))
    out = []
    for g in {g for g, _ in best}:
        out += sorted(((g, i, s) for (h, i), s in best.items() if h == g), key=lambda x: (-x[2], x[1].encode()))[:n]
    return sorted((g, i) for g, i, _ in out)


SCORE = st.one_of(st.sampled_from([0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, 1e-320, 0.3]), st.floats(allow_nan=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text(alphabet="abé\0", max_size=20), SCORE), max_size=60), st.integers(1, 6))
def test_selection_equals_sorting(rows, n):
    rows = list({(g, i): (g, i, s) for g, i, s in rows}.values())
    names = sorted({g for g, _, _ in rows})
    mask = select_rows(np.array([names.index(g) for g, _, _ in rows], dtype=np.int64), np.array([s for *_, s in rows], dtype=float), lambda at: [rows[k][1].encode() for k in at], n)
    assert sorted((g, i) for (g, i, _), m in zip(rows, mask) if m) == brute(rows, n)


@given(SCORE, SCORE)
def test_code_keeps_order(a, b):
    x, y = score_code(np.array([a, b], dtype=float))
    assert (x < y, x == y) == (a < b, a == b)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "g string, i string, s double, score int, item int")


@pytest.mark.parametrize("hot", [250_000, 30, 1])
def test_spread_and_gathered_groups_agree(spark, hot, monkeypatch):
    monkeypatch.setattr(topn, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [("hot", f"i{rng.integers(300):03d}" + "x" * int(rng.integers(12)), float(rng.integers(4))) for _ in range(700)]
    rows += [(f"g{rng.integers(40)}", f"c{rng.integers(30)}", float(rng.normal())) for _ in range(600)]
    rows += [("few", "a", 1.0), ("few", "a", 1.0), ("few", "b", None), (None, "a", 1.0), ("few", None, 2.0), ("few", "n", math.nan), ("same", "z", 1.0), ("same", "é", 1.0), ("same", "za", 1.0), ("", "", 0.0)]
    for n in (1, 5):
        got = sorted((r.g, r.i) for r in top_n(table(spark, rows), "g", "i", "s", n, hot).collect())
        assert got == brute(rows, n)


def test_close_scores_in_a_spread_group(spark):
    rows = [("h", f"i{k}", 1.0 + k * 2.0**-52) for k in range(200)] + [("h", "far", 1e300), ("h", "low", -1e300), ("h", "inf", math.inf), ("h", "minf", -math.inf), ("h", "zero", -0.0), ("h", "zero2", 0.0), ("h", "x" * 100_000, 1.0)]
    assert sorted((r.g, r.i) for r in top_n(table(spark, rows), "g", "i", "s", 7, 10).collect()) == brute(rows, 7)
    assert sorted((r.g, r.i) for r in top_n(table(spark, rows), "g", "i", "s", 206, 10).collect()) == brute(rows, 206)


def test_empty_and_none_wanted(spark):
    assert top_n(table(spark, []), "g", "i", "s", 5).count() == 0
    assert top_n(table(spark, [("a", "b", 1.0)]), "g", "i", "s", 0).count() == 0
