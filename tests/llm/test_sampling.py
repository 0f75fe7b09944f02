import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from alinea.llm import sampling
from alinea.llm.calibration import floored_totals, tilt
from alinea.llm.sampling import matched_samples, pivotal, whole_sizes

TARGET = "target_set string, band string, source string, share double, min_rows int, sample_rows int"
ITEM = "id int, band string, source string, share double, mark string, at int"


def test_tilt_meets_crossed_margins():
    # cells of a 3 x 2 table; row and column totals are wanted together
    rows = np.array([500.0, 40, 300, 200, 90, 10])
    x = np.array([[c // 2 == b for b in range(3)] + [c % 2 == s for s in range(2)] for c in range(6)], float)
    goal = np.array([40.0, 40, 20, 60, 40])
    p, converged = tilt(rows, x, goal)
    assert converged and np.allclose((rows * p) @ x, goal, atol=1e-6) and (p >= 0).all() and (p <= 1).all()
    # log p is additive in the categories wherever it is not cut at 1
    free = p < 1 - 1e-9
    a, *_ = np.linalg.lstsq(x[free], np.log(p[free]), rcond=None)
    assert np.allclose(x[free] @ a, np.log(p[free]), atol=1e-6)


def test_tilt_takes_all_of_what_is_short():
    p, converged = tilt(np.array([5.0, 100, 0]), np.eye(3), np.array([9.0, 20, 4]))
    assert np.allclose(p, [1, 0.2, 0]) and converged
    assert tilt(np.zeros(0), np.zeros((0, 2)), np.array([1.0, 2]))[0].size == 0


def test_contradicting_totals_are_named():
    assert tilt(np.array([100.0]), np.ones((1, 2)), np.array([10.0, 20.0]))[1] is False


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("01", min_size=3, max_size=3), st.integers(0, 30), st.floats(0, 1)), min_size=1, max_size=8), st.lists(st.floats(0, 1), min_size=3, max_size=3), st.integers(0, 9))
def test_whole_sizes_hold_floors_exactly(cells, shares, seed):
    room = {m: n for m, n, _ in cells}
    wanted = {m: n * p for m, n, p in cells}
    floors = {k: int(shares[k] * sum(n for m, n in room.items() if m[k] == "1")) for k in range(3)}
    n = whole_sizes(wanted, room, floors, random.Random(seed))
    assert all(0 <= n[m] <= room[m] for m in room)
    for k, f in floors.items():
        assert sum(v for m, v in n.items() if m[k] == "1") >= f
    if not any(floors.values()):
        assert all(abs(n[m] - wanted[m]) < 1 for m in room) and abs(sum(n.values()) - sum(wanted.values())) < 1


def test_floors():
    got = floored_totals(np.array([0.9, 0.09, 0.01]), np.array([0.0, 0, 5]), 100)
    assert got[2] == 5 and got.sum() == pytest.approx(100) and got[0] / got[1] == pytest.approx(10)
    assert list(floored_totals(np.array([0.5, 0.5]), np.array([8.0, 8]), 10)) == [8, 8]
    assert list(floored_totals(np.array([0.25]), np.array([1.0]), 100)) == [25]


def test_pivotal_keeps_probabilities_and_size():
    p = [0.1, 0.5, 0.9, 0.3, 0.7, 0.5, 1.0, 0.0]
    hits, sizes = Counter(), set()
    for k in range(20_000):
        taken, held = pivotal(enumerate(p), random.Random(k))
        assert held is None
        sizes.add(len(taken))
        hits.update(taken)
    assert sizes == {4}
    assert all(abs(hits[i] / 20_000 - q) < 0.02 for i, q in enumerate(p))


def frames(spark, items, targets):
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(targets, TARGET)


def test_samples_and_report(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK_ROWS", 100)
    items = [(i, ("Weak", "con firmed", " weak_")[i % 3], "a-b" if i % 10 else "C", 0.0, "x", 0) for i in range(1, 1501)]
    items += [(2000, "rare", "c", 0.0, "x", 0)] * 50 + [(2001, None, None, 0.0, "x", 0), (None, "rare", "c", 0.0, "x", 0), (2002, "odd", "A_B", 0.0, "x", 0)]
    targets = [
        ("one", "weak", "*", 0.5, 1, 60), ("one", "confirmed", "*", 0.45, 1, 60), ("one", "rare", "*", 0.05, 2, 60),
        ("both", "weak", "*", 0.7, 0, 90), ("both", "*", "AB", 0.4, 0, 90), ("both", "*", "c", 0.6, 0, 90),
        ("part", "*", "c", 0.1, 0, 50), ("none", "absent", "*", 1.0, 3, 10), ("all", "*", "*", 1.0, 0, 20),
        ("null", None, "c", None, None, None),
    ]
    sample, report = matched_samples(*frames(spark, items, targets), "id")
    rows = [tuple(r) for r in sample.collect()]
    assert len({(s, i) for s, i, *_ in rows}) == len(rows)
    count = Counter((s, b, c) for s, _, b, c, _ in rows)
    by = lambda s, b=None, c=None: sum(n for (x, y, z), n in count.items() if x == s and b in (None, y) and c in (None, z))
    assert (by("one", "weak"), by("one", "confirmed"), by("one", "rare")) == (30, 27, 1)
    assert by("both") == 90 and abs(by("both", "weak") - 63) <= 2 and abs(by("both", c="c") - 54) <= 2
    assert by("part") == 50 and by("part", c="c") == 5 and by("none") == 0 and by("all") == 20
    lines = {(r.target_set, r.band, r.source): r for r in report.collect()}
    assert len(lines) == len(targets)
    assert {k for k, r in lines.items() if r.gap} == {("one", "rare", "*"), ("none", "absent", "*")}
    assert lines["one", "rare", "*"].available == 1 and lines["one", "rare", "*"].sampled == 1
    assert lines["all", "*", "*"].available == 1503
    again = matched_samples(*frames(spark, items[::-1], targets), "id")[0]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in again.collect())


def test_floors_nobody_can_fill_take_nothing_from_others(spark):
    items = [(i, "a" if i % 2 else "b", f"s{i % 7}", 0.0, "x", 0) for i in range(400)]
    targets = [("t", "a", "*", 0.5, 0, 100), ("t", "b", "*", 0.5, 0, 100), ("t", "gone", "*", 0.0, 7, 100), ("t", "*", "s3", 0.01, 4, 100)]
    sample, report = matched_samples(*frames(spark, items, targets), "id")
    got = {(r.band, r.source): r for r in report.collect()}
    assert (got["a", "*"].aimed, got["b", "*"].aimed, got["gone", "*"].aimed) == (50, 50, 0) and got["gone", "*"].gap
    assert got["*", "s3"].sampled == 4 == sample.where("source = 's3'").count() and all(r.converged for r in got.values())
    assert {k: r.off for k, r in got.items()}["gone", "*"] == 0


def test_an_item_sent_again(spark):
    items = [(1, "a", "s", 0.0, "x", 1), (1, "b", "s", 0.0, "x", 2), (2, "a", "s", 0.0, "x", 1)]
    targets = [("t", "a", "*", 0.5, 0, 2), ("t", "b", "*", 0.5, 0, 2)]
    sample, report = matched_samples(*frames(spark, items, targets), "id", latest="at")
    assert sorted((r.id, r.band) for r in sample.collect()) == [(1, "b"), (2, "a")]
    assert sorted((r.band, r.available, r.gap) for r in report.collect()) == [("a", 2, False), ("b", 1, False)]


def test_empty(spark):
    items, targets = [(1, "a", "s", 0.0, "x", 1)], [("t", "a", "*", 0.5, 1, 2)]
    sample, report = matched_samples(*frames(spark, [], targets), "id")
    assert sample.count() == 0 and [(r.available, r.gap) for r in report.collect()] == [(0, True)]
    sample, report = matched_samples(*frames(spark, items, []), "id")
    assert sample.count() == report.count() == 0
