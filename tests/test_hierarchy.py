import pytest
from pyspark.sql import functions as F

from alinea.functions.text import clip, natural_key, norm, wilson
from alinea.operators.current import current
from alinea.operators.hierarchy import ancestors, chain_text, children, inherit, path_order, roll_up

TREE = [("r", None, "should", "root:", "1"), ("a", "r", None, "first", "1.a"), ("a1", "a", None, "deep", "1.a.1"), ("b", "r", "may", "second", "1.b"), ("lone", "gone", None, "alone", "2"), ("j", "r", None, "tenth", "1.j")]


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(TREE, "id string, up string, verb string, text string, path string")


def test_closure_and_cycles(spark, tree):
    assert sorted(map(tuple, ancestors(tree, "id", "up").collect())) == [("a", "r", 1), ("a1", "a", 1), ("a1", "r", 2), ("b", "r", 1), ("j", "r", 1)]
    with pytest.raises(ValueError):
        ancestors(spark.createDataFrame([("x", "y"), ("y", "x")], "id string, up string"), "id", "up", most=5)
    assert ancestors(tree.limit(0), "id", "up").count() == 0


def test_inheritance(tree):
    got = {r.id: (r.own, r.verb, r.inherited) for r in inherit(tree, ancestors(tree, "id", "up"), "id", "verb").collect()}
    assert got == {"r": ("should", "should", False), "a": (None, "should", True), "a1": (None, "should", True), "b": ("may", "may", False), "lone": (None, None, False), "j": (None, "should", True)}


def test_roll_up_children_and_chain(tree):
    up = ancestors(tree, "id", "up")
    full = {r.id: r.full_text for r in roll_up(tree, up, "id", "text", path_order("path")).collect()}
    assert full["r"] == "root: first deep second tenth" and full["a"] == "first deep" and full["lone"] == "alone"
    kids = {r.id: (r.n_children, r.child_ids) for r in children(tree, "id", "up", path_order("path")).collect()}
    assert kids["r"] == (3, ["a", "b", "j"]) and kids["a1"] == (0, [])
    assert {r.id: r.chain for r in chain_text(tree, up, "id", "text").collect()}["a1"] == "root: first"


def test_current_rows(spark):
    rows = [("a", 1, None), ("a", 2, 5), ("b", 3, 4), ("b", 9, None), (None, 1, None)]
    got = current(spark.createDataFrame(rows, "k string, at int, ended int"), "k", "at", "ended").collect()
    assert [tuple(r) for r in got] == [("b", 9, None)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("3.2.10", "  “A” –\xa0ﬁne\n b ", "one two three four")], "k string, t string, w string")
    r = df.select(natural_key("k").alias("k"), norm("t").alias("n"), norm("t", True).alias("p"), clip("w", 10).alias("c"), clip("w", 99).alias("all")).first()
    assert (r.k, r.n, r.p, r.c, r["all"]) == ([3, 2, 10], '"a" - fine b', '"a" - ﬁne b', "one two…", "one two three four")
    cases = spark.createDataFrame([(27, 30), (0, 0), (0, 8), (8, 8)], "h int, n int")
    got = {(x.h, x.n): (round(x.lo, 4), round(x.hi, 4)) for x in cases.select("h", "n", wilson(F.col("h"), F.col("n"), False).alias("lo"), wilson(F.col("h"), F.col("n"), True).alias("hi")).collect()}
    assert got[27, 30] == (0.7438, 0.9654) and got[0, 0] == (0, 0) and got[0, 8][0] == 0 and got[8, 8][1] == 1
