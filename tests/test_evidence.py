import math
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alinea.operators.evidence import changed, complete, grade, in_band, judgments, mock_debate, mock_proposals, overlay, prompts, resolve, shares, spread_sample, verify

ROW = "line_no int, finding_no int, clause_id string, offered array<string>, control_id string, relationship string, confidence double, evidence_sama string, evidence_nist string"
FOCAL, TARGET = "The unit shall keep “amber” logs for ﬁve years.", "Keep logs\nfor a period. Review them."
GOOD = ("C1", ["A-1"], "a-1 ", "Subset of", 0.7, 'keep "amber"  LOGS for five', "keep logs for a period")


def change(**by):
    names = ["clause_id", "offered", "control_id", "relationship", "confidence", "evidence_sama", "evidence_nist"]
    return tuple(by.get(n, v) for n, v in zip(names, GOOD))


CASES = [
    (GOOD, []),
    (change(offered=["B-1"]), ["not_offered"]),
    (change(offered=None), ["not_offered"]),
    (change(control_id=None), ["not_offered", "target_not_verbatim"]),
    (change(relationship="not_related"), ["no_reportable_relation"]),
    (change(relationship=None), ["no_reportable_relation"]),
    (change(confidence=1.2), ["bad_confidence"]),
    (change(confidence=math.nan), ["bad_confidence"]),
    (change(confidence=None), ["bad_confidence"]),
    (change(evidence_sama="keep amber log"), ["focal_too_short"]),
    (change(evidence_sama="keep  amber log!"), ["focal_not_verbatim"]),
    (change(evidence_nist=None), ["target_too_short"]),
    (change(evidence_nist="keep logs for ever and ever"), ["target_not_verbatim"]),
    (change(clause_id="missing"), ["focal_not_verbatim"]),
]


@pytest.mark.parametrize("hot", [250_000, 1])
def test_gate(spark, hot):
    rows = spark.createDataFrame([(i, 1, *c) for i, (c, _) in enumerate(CASES)], ROW)
    focal = spark.createDataFrame([("C1", FOCAL)], "key string, text string")
    target = spark.createDataFrame([("A-1", TARGET)], "key string, text string")
    got = {r.line_no: r.errors for r in verify(rows, focal, target, hot_rows=hot).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}
    assert verify(rows.limit(0), focal, target).count() == 0
    grades = spark.createDataFrame([([], 0.6), ([], 0.59), (["x"], 1.0)], "e array<string>, c double").select(grade(F.col("e"), F.col("c"), 0.6)).collect()
    assert [r[0] for r in grades] == ["accepted", "disputed", "rejected"]
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_judgments_keep_places(spark):
    df = spark.createDataFrame([(1, "c", ["o"], [None, ("X",)]), (2, "c", None, []), (3, None, None, None)], "line_no int, clause_id string, offered array<string>, findings array<struct<control_id:string>>")
    assert [(r.line_no, r.finding_no, r.control_id) for r in judgments(df).collect()] == [(1, 2, "X")]


def test_rulings(spark):
    df = spark.createDataFrame([("uphold", [], 0.7, "a", "a"), ("revise", [], 0.5, "a", "b"), ("revise", ["x"], 0.9, "a", "a"), ("reject", [], 0.9, "a", None), (None, [], 0.9, "a", "b")], "r string, e array<string>, c double, x string, y string")
    got = df.select(resolve(F.col("r"), F.col("e"), F.col("c"), 0.6).alias("s"), changed(F.col("r"), [F.col("x")], [F.col("y")]).alias("d")).collect()
    assert [tuple(r) for r in got] == [("accepted", False), ("disputed", True), ("rejected", False), ("rejected_by_debate", False), ("unresolved", False)]
    rows = spark.createDataFrame([(0.5, "disputed"), (0.69, "accepted"), (0.7, "accepted"), (0.6, "rejected"), (None, None)], "c double, s string")
    c, s = F.col("c"), F.col("s")
    assert [tuple(r) for r in rows.select(in_band(c, s, 0.5, 0.7), in_band(c, s), in_band(c, s, below=0.6)).collect()] == [(True, True, True), (True, True, False), (False, True, False), (False, False, False), (False, True, True)]


def test_overlay_last_ruling_wins(spark):
    rows = spark.createDataFrame([("a", 1, "equal", 0.5, 7), ("a", 1, "equal", 0.5, 8), ("b", 1, "equal", None, 9), (None, 1, "equal", 0.1, 10)], "k string, n int, rel string, conf double, ruled_at int")
    rulings = spark.createDataFrame([("a", 1, "subset_of", 0.9, 2, 1), ("a", 1, "superset_of", None, 2, 2), ("a", 1, "x", 0.1, 1, 9), (None, 1, "x", 0.1, 1, 9), ("c", 1, "x", 0.1, 1, 9)], "k string, n int, rel string, conf double, at int, id int")
    for hot in (250_000, 1):
        got = sorted((r.ruled_at, r.original_rel, r.rel, r.conf, r.ruled) for r in overlay(rows, rulings, ["k", "n"], ["rel", "conf"], ["at", "id"], hot).collect())
        assert got == [(7, "equal", "superset_of", 0.5, True), (8, "equal", "superset_of", 0.5, True), (9, "equal", "equal", None, False), (10, "equal", "equal", 0.1, False)]


def test_stand_ins_and_prompts(spark):
    short = spark.createDataFrame([("c", f"k{i}", i) for i in range(1, 6)], "query string, control_id string, rank int")
    focal = spark.createDataFrame([("c", " ".join(f"w{i}" for i in range(20)))], "key string, text string")
    target = spark.createDataFrame([("k1", "text one"), ("k2", ""), ("k3", "text three")], "key string, text string")
    made = mock_proposals(short, focal, target)
    got = {r.control_id: r for r in made.collect()}
    assert set(got) == {"k1", "k3"} and got["k1"].evidence_sama == " ".join(f"w{i}" for i in range(14)) and got["k3"].confidence == 0.71
    ruled = {r.control_id: (r.ruling, r.new_relationship, r.new_confidence) for r in mock_debate(made).collect()}
    assert ruled == {"k1": ("uphold", "subset_of", 0.92), "k3": ("uphold", "equal", 0.81)}
    rows = spark.createDataFrame([("c", "T", [("k", "Title", "")])], "id string, text string, candidates array<struct<control_id:string,title:string,statement:string>>")
    asked = prompts(rows, {"id": "Clause", "text": "Text"})
    assert asked.first().prompt == "Clause: c\nText: T\n### k Title\n(no statement)\nReturn a JSON array."

    def client():
        def ask(p):
            if "T" not in p:
                raise RuntimeError("no")
            return p[:6]
        return ask

    both = asked.select("id", "prompt").union(spark.createDataFrame([("d", "x")], "id string, prompt string"))
    assert sorted(map(tuple, complete(both, "id", "prompt", client).collect())) == [("c", "Clause", ""), ("d", None, "RuntimeError: no")]


def test_shares_and_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)] + [(1000 + i, "c") for i in range(3)] + [(2000, None)], "id int, s string")
    assert {r.s: (r.n, r.percent) for r in shares(df, ["s"]).collect()} == {"a": (200, 65), "b": (100, 32), "c": (3, 0), None: (1, 0)}
    got = spread_sample(df, F.col("s"), "id", 30).collect()
    assert Counter(r.s for r in got) == {"a": 20, "b": 10, "c": 3}
    assert sorted(r.id for r in got) == sorted(r.id for r in spread_sample(df.orderBy(F.desc("id")), F.col("s"), "id", 30).collect())
    assert spread_sample(df.limit(0), F.col("s"), "id", 30).count() == 0
