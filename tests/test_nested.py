import json

import pytest

from alinea.operators.nested import bridge, flatten_judgments, json_values, merkle_objects, shred, unread

DOC = "src_table string, line_no bigint, payload string, node_hash string"


def shredded(spark, *payloads):
    return shred(spark.createDataFrame([("t", i, p, "clash") for i, p in enumerate(payloads, 1)], DOC)).cache()


def flat(spark, *payloads):
    return sorted(tuple(r)[1:] for r in flatten_judgments(shredded(spark, *payloads)).collect())


def test_json_among_other_text():
    assert json_values('```json\n{"a": true}\n```') == ([{"a": True}], "")
    assert json_values('See [note] here: {"a": [1]} thanks') == ([{"a": ["1"]}], "")
    record = {"clause_id": "c", "findings": []}
    said = json.dumps(record)
    for before in ("See item [3]: ", "Set {a, b} of [1, 2] or ", "{", "[see ", '["', *(f'["{"x" * n}" and so on] then ' for n in (10, 100, 10_000)), *(f'{{{"x" * n} then ' for n in (10, 10_000)), '["x" '):
        found, amiss = json_values(before + said)
        assert record in found and not amiss, before
    assert json_values(f"{said}\n{said} [4]") == ([record, record, ["4"]], "")
    assert json_values(f"[{said} and more]") == ([record], "")  # a whole record in broken JSON
    assert json_values('{"a": {"b": 1}, oops}') == ([], "broken")


@pytest.mark.parametrize("cut", ['{"a": 1', '{"a": "x', '[{"a": 1}, {"b"', '{"a": "\\u00', '{"a": 0.', '{"a": 1e', '{"a": fals', "[", '{"a": {"clause_id": "x", "findings": [{"control_id": "y", "why": "see [3]"}]}, '])
def test_cut_off_json_gives_nothing(cut):
    assert json_values(cut) == ([], "cut off")


def test_nothing_to_read():
    assert [json_values(x) for x in (None, "", "  ", "none", "null", '"{}"'[:1])] == [([], "null"), ([], "empty"), ([], "empty"), ([], "no JSON"), ([], "no JSON"), ([], "no JSON")]


def test_numbers_stay_as_written():
    big = "9" * 5000
    assert json_values(f"[0.50, 1e999, NaN, -Infinity, {big}]") == ([["0.50", "1e999", "NaN", "-Infinity", big]], "")


def test_shapes_places_and_rounds(spark):
    ruled = {"ruling": {"control_id": "R", "relationship": None}}
    one = {"clause_id": "C1", "findings": [{"control_id": "A", "relationship": "equal", "rounds": [ruled, 5, {"ruling": None}]}, 0, None, {"debate": {"rounds": ruled}}]}
    inner = {"clause": {"clause_id": "C2"}, "result": {"findings": json.dumps([{"control_id": "B"}])}}
    batch = {"batch": {"records": [{"clause_id": "X", "parse_error": "no"}, inner, {"result": {"judge": {"findings": {"control_id": 7}}}, "clause_id": None}]}}
    assert flat(spark, json.dumps(one), json.dumps(batch), json.dumps([one])[:-3], json.dumps([inner])) == [
        (1, 1, 1, 0, "C1", "A", "equal"),
        (1, 1, 1, 1, "C1", "R", ""),
        (1, 1, 1, 3, "C1", "", ""),
        (1, 1, 4, 0, "C1", "", ""),
        (1, 1, 4, 1, "C1", "R", ""),
        (2, 2, 1, 0, "C2", "B", ""),
        (2, 3, 1, 0, "", "7", ""),
        (4, 1, 1, 0, "C2", "B", ""),
    ]


def test_identical_objects_are_kept_once_and_rebuild_the_document(spark):
    doc = {"clause_id": "é", "findings": [{"control_id": "A", "x": {"k": [1, "two", None, True]}}] * 3, "y": {"k": [1, "two", None, True]}}
    occ = shredded(spark, json.dumps(doc), json.dumps(doc, indent=3), None)
    objects = {r.node_hash: r for r in merkle_objects(occ).collect()}
    assert sum(r.n_occurrences for r in objects.values()) == bridge(occ).count() == occ.count() - 1
    assert len(objects) == 5  # root, list, finding, x, k
    assert all(r.canonical is not None for r in objects.values())

    def build(h):
        def fill(v):
            return build(v["#"]) if isinstance(v, dict) else v
        form = json.loads(objects[h].canonical)
        return {k: fill(v) for k, v in form.items()} if isinstance(form, dict) else [fill(v) for v in form]

    roots = [r.node_hash for r in occ.where("parent_occ is null and kind <> 'unread'").collect()]
    assert [build(h) for h in roots] == [doc, doc]


def test_documents_from_objects_bridge_and_ordinals(spark):
    docs = [
        {"clause_id": "C", "x": [1.5, [], {}, {"#": "trap"}, "t"], "findings": [{"control_id": '{"#":"no link"}', "relationship": '{"=":"5"}', "z": None}]},
        [[{"b": [1, 2, {"a": []}]}], "s", [False]],
        {"#": {"=": ["x"]}, "=": "y"},
    ]
    occ = shredded(spark, *map(json.dumps, docs[:2]), f"said {json.dumps(docs[2])} and {json.dumps(docs[1])}")
    objects = {r.node_hash: json.loads(r.canonical) for r in merkle_objects(occ).collect()}
    rows = sorted(bridge(occ).collect(), key=lambda r: (r.line_no, r.occ_no))
    assert len(set(r.occ_no for r in rows if r.line_no == 3)) == sum(r.line_no == 3 for r in rows)

    def build(r):
        inner = [x for x in rows if x.line_no == r.line_no and x.parent_occ == r.occ_no]
        form = objects[r.node_hash]
        if r.kind == "array":
            out = list(form)
            for x in inner:
                out[x.ordinal - 1] = build(x)
            return out
        return {**{k: v for k, v in form.items() if not isinstance(v, dict)}, **{x.step: build(x) for x in inner}}

    assert [build(r) for r in rows if r.parent_occ is None] == [*docs, docs[1]]
    flat_rows = {(r.control_id, r.relationship) for r in flatten_judgments(occ).collect()}
    assert flat_rows == {('{"#":"no link"}', '{"=":"5"}')}  # text that looks like a link is text


def test_unread_payloads_are_named(spark):
    occ = shredded(spark, None, " ", "prose", '{"a": ', '{"a" "b"}', "[1]", '{"clause_id": "c", "findings": [{}]} {"clause_id": "d", "fin')
    assert {(r.line_no, r.reason) for r in unread(occ).collect()} == {(1, "null"), (2, "empty"), (3, "no JSON"), (4, "cut off"), (5, "broken"), (7, "cut off")}
    assert [r.clause_id for r in flatten_judgments(occ).collect()] == ["c"]


def test_further_values_are_counted_on(spark):
    one = {"clause_id": "a", "findings": [{"control_id": "k"}]}
    assert [r[1] for r in flat(spark, f"{json.dumps(one)} then {json.dumps([one, one])} [3] {json.dumps(one)}")] == [1, 2, 3, 4]


def test_nothing_in_nothing_out_and_depth(spark):
    assert flat(spark, None, "", "[]") == []
    for depth in (500, 20_000, 100_000):
        deep = '{"clause_id": "D", "findings": [{"control_id": "A", "z": ' + '[{"a":' * (depth // 2) + "1" + "}]" * (depth // 2) + "}]}"
        assert flat(spark, deep) == [(1, 1, 1, 0, "D", "A", "")]
    long = json.dumps({"clause_id": "L", "findings": [{"control_id": "x" * 300_000}]})
    assert len(flat(spark, long)[0][5]) == 300_000
