"""Report rules against literal rows."""

import pytest
from pyspark.sql import functions as F

from alinea.functions.text import clip, enumerative
from alinea.operators import evidence, records
from alinea.operators.order import places
from alinea.operators.routing import missing_routes, recall_by_group, route, route_single
from alinea.plans.findings import band_of
from alinea.plans.stage import drop, once, staged
from alinea.plans.unions import union_all


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression("x")).first()[0]


@pytest.mark.parametrize("text,most,want", [
    ("short", 5, "short"), ("one two  three", 8, "one two…"), ("one two", 5, "one…"), ("abcdefgh", 4, "abcd…"), ("one two", 3, "one…"), ("one two three", 7, "one…"), (None, 4, ""), ("", 4, ""),
])
def test_clip(spark, text, most, want):
    assert one(spark, text, lambda c: clip(c, most)) == want


@pytest.mark.parametrize("text,inherits,want", [
    ("cyber security specialists;", True, True), ("minimum number of participants.", True, True), ("  specialists; ", True, True),
    ("specialists;", False, False), ("specialists", True, False), ("keys are kept;", True, False), ("Logs can go;", True, False),
    ("access granted to the vendors;", True, False), ("reviews for the board;", True, False), ("testing with care;", True, False), ("a" * 70 + ";", True, False), ("must;", True, False), ("mustard;", True, True), (None, True, False),
])
def test_list_items(spark, text, inherits, want):
    assert one(spark, text, lambda c: enumerative(F.col(c), F.lit(inherits))) is want


@pytest.mark.parametrize("content,kind,address,want", [
    (b"%PDF-1.7", "text/html", "x.html", "pdf"), (b"<a>", "application/PDF", "x", "pdf"), (b"<a>", "text/html", "x.PDF", "pdf"), (b"<a>", None, "https://x/", "html"), (b"<a>", "TEXT/HTML; q", "x", "html"), (b"<a>", "", "x.HTM", "html"),
    (b"PK", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "x", "docx"), (b"PK", None, "x.docx", "docx"), (b"PK", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "x", "xlsx"), (b"PK", None, "x.xls", "xlsx"),
    (b"a", "text/plain; charset=utf-8", "x", "txt"), (b"a", None, "x.txt", "unknown"), (b"{}", "application/json", "x.json", "unknown"), (None, None, None, "unknown"), (b"", "", "", "unknown"),
])
def test_formats(spark, content, kind, address, want):
    df = spark.createDataFrame([(content, kind, address)], "c binary, k string, a string")
    assert df.select(records.sniff(F.col("c"), F.col("k"), F.col("a"))).first()[0] == want


REG = "doc_id string, tier string, url string, sha256 string, local_path string, url_accessed string, notes string"
GOOD = ("AB-CDE-FGH-2020", "core", "u", "a" * 64, "p", "2024-01-02", "One. Two.")


@pytest.mark.parametrize("change,error", [
    ({}, None), ({0: "ab-c"}, "bad doc_id"), ({0: None}, "bad doc_id"), ({1: "extended"}, "unknown tier"), ({1: None}, "unknown tier"), ({2: ""}, "core record without url"), ({3: None}, "core record without sha256"), ({4: None}, "core record without local_path"), ({5: None}, "core record without url_accessed"),
    ({3: "A" * 64}, "malformed sha256"), ({5: "02.01.2024"}, "bad date"), ({6: "One. Two. One."}, "sentence twice in notes"), ({6: "a\nb"}, "line break in notes"), ({1: "method", 2: None}, "record without url"), ({1: "method", 3: None}, None),
])
def test_register_guard(spark, change, error):
    row = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    assert [r.error for r in records.guard(spark.createDataFrame([row], REG), 1).collect()] == ([error] if error else [])


def test_register_guard_of_the_whole(spark):
    found = records.guard(spark.createDataFrame([GOOD, GOOD], REG), 3).collect()
    assert sorted((r.doc_id, r.error) for r in found) == [(None, "duplicate doc_id"), (None, "row count 2 is not 3")]
    assert records.guard(spark.createDataFrame([], REG)).count() == 0


def test_readiness(spark):
    some, none = spark.range(3), spark.range(0)
    assert tuple(records.readiness({"a": some, "b": some}).first()) == (True, "")
    assert tuple(records.readiness({"z": none, "a": some, "b": none}).first()) == (False, "z, b")


def test_places(spark):
    rows = [(i * 7919 % 1000, "c") for i in range(1000)]
    got = places(spark.createDataFrame(rows, "x int, place string").drop("place"), F.desc("x")).collect()
    assert sorted((r.place, r.x) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert places(spark.createDataFrame([], "x int"), F.asc("x")).count() == 0


def test_union_rows_of_a_group_come_together(spark):
    a = spark.range(2000).select((F.col("id") % 50).alias("q"), "id").groupBy("q", "id").count()
    parts = [a.where(f"id % 3 = {k}").repartition("q").withColumn("l", F.lit(k)) for k in range(3)]
    assert union_all(parts).groupBy("q").agg(F.count("l").alias("n")).where("n <> 40").count() == 0
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_bands(spark):
    df = spark.createDataFrame([(c,) for c in (None, 0.0, 0.549, 0.55, 0.699, 0.70, 1.0, 1.01)], "c double")
    assert [r[0] for r in df.select(band_of(F.col("c"))).collect()] == ["weak", "weak", "weak", "provisional", "provisional", "confirmed", "confirmed", "weak"]


def test_routes_with_and_without_vectors(spark):
    lists = "query string, item string, score double, rank int"
    own = spark.createDataFrame([("q", "a", 9.0, 1), ("q", "b", 8.0, 2), ("p", "b", 1.0, 1)], lists)
    dense = spark.createDataFrame([("q", "b", 0.9, 1), ("q", "c", 0.8, 2)], lists)
    prior = spark.createDataFrame([("g", "c", 1.0, 1)], lists)
    keys = spark.createDataFrame([("q", "g"), ("p", None)], "query string, group string")
    plain = {(r.query, r.item): r.rank for r in route(own, prior, keys, 5).collect()}
    assert plain == {("q", "a"): 1, ("q", "c"): 2, ("q", "b"): 3, ("p", "b"): 1}
    both = {(r.query, r.item): r.rank for r in route(own, prior, keys, 5, dense).collect()}
    assert both == {("q", "b"): 1, ("q", "c"): 2, ("q", "a"): 3, ("p", "b"): 1}
    assert [(r.query, r.item, r.score) for r in route_single(own, None, 1).orderBy("query").collect()] == [("p", "b", 1.0), ("q", "a", 9.0)]
    assert route_single(own, dense, 1).where("query = 'q'").first().item == "b"


def test_missing_routes_and_recall_by_group(spark):
    targets = spark.createDataFrame([("a",), ("b",)], "k string")
    assert tuple(missing_routes(targets, spark.createDataFrame([("a",), ("a",)], "k string"), "k").first()) == (2, 1, False)
    assert tuple(missing_routes(targets, targets, "k").first()) == (2, 0, True)
    ranks = spark.createDataFrame([("a", "x", 1), ("b", "x", 4)], "query string, item string, rank int")
    want = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "query string, item string")
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "query string, group string")
    assert sorted(map(tuple, recall_by_group(ranks, want, groups, 3).collect())) == [("g", 2, 1, 0.5, True), ("h", 1, 0, 0.0, True)]
    assert sorted(map(tuple, recall_by_group(ranks, want, groups, 4).collect()))[0] == ("g", 2, 2, 1.0, False)


def test_debate_prompts(spark):
    spec = """clause struct<clause_id: string, subdomain: string, subdomain_title: string, principle: string, text: string, n_children: int, full_text: string, numeric_params: array<string>>,
      finding struct<control_id: string, relationship: string, confidence: double, evidence_sama: string, evidence_nist: string, rationale: string>,
      control struct<control_id: string, title: string, family: string, family_title: string, is_enhancement: boolean, parent_id: string, statement: string, params: array<string>>,
      others array<struct<control_id: string, title: string, family: string, family_title: string, is_enhancement: boolean, parent_id: string, statement: string, params: array<string>>>,
      objection struct<objection: boolean, grounds: string, argument: string, proposed_relationship: string, proposed_control_id: string, strength: double>"""
    k = lambda n, e=False: (n, f"T {n}", "F", "Fam", e, "P" if e else None, "S" * 300, ["p"] if e else [])
    row = (("c1", "3.1", "Sub", "Keep", "Text.", 1, "Text. Item.", ["daily"]), ("A", "equal", 0.5, "ea", None, "why"), k("A"), [k("A"), *(k(f"B{i}", True) for i in range(8))], (True, "wrong_control", "no", "", "B7", 0.7))
    df = spark.createDataFrame([row, (row[0], row[1], None, [], (False, "", "fine", "", "", 0.0))], spec)
    asked = [r[0] for r in df.select(evidence.opponent_prompt(F.col("clause"), F.col("finding"), F.col("control"), F.col("others"))).collect()]
    assert "Principle of the subdomain: Keep" in asked[0] and "With its items:\nText. Item." in asked[0] and "States a value: daily" in asked[0] and "Evidence from the control: “”" in asked[0]
    assert asked[0].count("\n- B") == 6 and "- A" not in asked[0] and "S" * 221 not in asked[0].split("## Other")[1]
    assert "## Other controls" not in asked[1] and asked[1].endswith("Return the JSON object now.")
    ruled = [r[0] for r in df.select(evidence.arbiter_prompt(F.col("clause"), F.col("finding"), F.col("objection"), F.col("control"), F.col("others"))).collect()]
    cited = [line[4:].split(" - ")[0] for line in ruled[0].split("\n") if line.startswith("### ")]
    assert cited == ["A", "B7", "B0", "B1", "B2", "B3", "B4"] and "Proposed instead: (unchanged) on B7" in ruled[0] and "Enhancement of P" in ruled[0]
    assert "No objection raised. Reason given: fine" in ruled[1]


def test_once_makes_again_what_was_written_anew(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return staged(spark.read.parquet(f"{tmp_path}/t.parquet"), "t")

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert once(spark, str(tmp_path), ("t",), "x", make).count() == once(spark, str(tmp_path), ("t",), "x", make).count() == 3
    assert len(made) == 1
    drop(once(spark, str(tmp_path), ("t",), "x", make))
    assert once(spark, str(tmp_path), ("t",), "x", make).count() == 3 and len(made) == 2
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert once(spark, str(tmp_path), ("t",), "x", make).count() == 5
