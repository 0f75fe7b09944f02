from datetime import datetime as dt

from alinea.operators.orphans import direct_orphans, orphan_report, orphans, with_reason

REF = "src_table string, src_field string, record_id bigint, ref_table string, ref_key string, at timestamp, own_key string, own_from timestamp, own_to timestamp, extra int"
TGT = "ref_table string, key string, valid_from timestamp, valid_to timestamp"
T = [dt(2024, m, 1) for m in range(1, 7)]


def refs(spark, rows):
    return spark.createDataFrame([(*r, *((None, None) if len(r) == 7 else ()), 1) for r in rows], REF)


def test_direct_spans_nulls_and_copies(spark):
    r = refs(spark, [
        ("f", "k", 1, "c", "A", T[2], None), ("f", "k", 1, "c", "A", T[2], None),  # held
        ("f", "k", 2, "c", "A", T[0], None),  # before it was loaded
        ("f", "k", 3, "c", "A", T[4], None),  # withdrawn just then
        ("f", "k", 4, "c", "Z", T[2], None), ("f", "k", 4, "c", "Z", T[2], None),  # unknown key, twice
        ("f", "k", 5, "c", None, T[2], None),  # no reference
        ("f", "k", 6, "c", "A", None, None),  # no time: no span covers it
    ])
    t = spark.createDataFrame([("c", "A", T[1], T[4]), ("c", None, T[0], None), ("other", "Z", T[0], None)], TGT)
    for hot in (250_000, 1):
        got = sorted(x.record_id for x in direct_orphans(r, t, hot).collect())
        assert got == [2, 3, 4, 6]


def test_cascade_reaches_grandchildren_and_ends_on_cycles(spark):
    rows = [
        ("n", "p", None, "n", "GONE", T[1], "A", T[0], None),  # direct
        ("n", "p", None, "n", "A", T[1], "B", T[0], None),  # inherited, depth 1
        ("n", "p", None, "n", "B", T[1], "C", T[0], None),  # depth 2
        ("n", "p", None, "n", "C", T[1], "A", T[0], None),  # closes a cycle: depth 3
        ("n", "p", None, "n", "OK", T[1], "D", T[0], None),
        ("leaf", "q", 7, "n", "C", T[1], None),  # depth 3
        ("leaf", "q", 8, "n", "D", T[1], None),
        ("leaf", "q", 9, "n", "A", T[1], None), ("leaf", "q", 9, "n", "A", T[1], None),  # depth 1, though the cycle comes by again
    ]
    t = spark.createDataFrame([("n", k, T[0], None) for k in ("A", "B", "C", "D", "OK")], TGT)
    want = {("A", "GONE"): ("direct", 0), ("B", "A"): ("inherited", 1), ("C", "B"): ("inherited", 2), ("A", "C"): ("inherited", 3), (7, "C"): ("inherited", 3), (9, "A"): ("inherited", 1)}
    for hot in (250_000, 1):
        found = orphans(refs(spark, rows), t, hot).collect()
        assert {(x.own_key or x.record_id, x.ref_key): (x.kind, x.depth) for x in found} == want and len(found) == len(want)


def test_only_the_orphaned_version_of_a_key_passes_it_on(spark):
    rows = [
        ("n", "p", None, "n", "GONE", T[0], "A", T[0], T[2]),  # the first version of A is an orphan
        ("n", "p", None, "n", "OK", T[2], "A", T[2], None),  # the second isn't
        ("leaf", "q", 1, "n", "A", T[1], None),
        ("leaf", "q", 2, "n", "A", T[2], None),
        ("leaf", "q", 3, "n", "A", T[4], None),
    ]
    t = spark.createDataFrame([("n", "A", T[0], T[2]), ("n", "A", T[2], None), ("n", "OK", T[0], None)], TGT)
    assert {x.record_id: x.kind for x in orphans(refs(spark, rows), t).collect() if x.src_table == "leaf"} == {1: "inherited"}


def test_reasons(spark):
    rows = [("f", "k", 1, "c", "A", T[0], None), ("f", "k", 2, "c", "A", T[5], None), ("f", "k", 3, "c", "Z", T[5], None), ("f", "k", 4, "c", "A", None, None)]
    t = spark.createDataFrame([("c", "A", T[1], T[4]), ("c", "A", T[2], T[3]), ("d", "Z", T[0], None)], TGT)
    found = with_reason(orphans(refs(spark, rows), t), t)
    assert {x.record_id: x.reason for x in found.collect()} == {1: "not yet there", 2: "ended", 3: "never there", 4: "no time"}
    got = sorted(map(tuple, orphan_report(found).collect()), key=repr)
    assert got == [("f", "k", "2024-01", 1, 0, 0, 0, 1, 1), ("f", "k", "2024-06", 2, 0, 1, 1, 0, 2), ("f", "k", None, 1, 0, 0, 0, 0, 1)]


def test_empty_tables_and_records_without_an_id(spark):
    none, t = refs(spark, []), spark.createDataFrame([], TGT)
    assert orphans(none, t).count() == 0
    rows = [("f", "k", 1, "c", "A", T[0], None), ("n", "p", None, "n", "X", T[0], "K", T[0], None), ("n", "p", None, "n", "X", T[0], "L", T[0], None)]
    found = with_reason(orphans(refs(spark, rows), t), t)
    assert {(x.src_table, x.n_direct, x.n_records) for x in orphan_report(found).collect()} == {("f", 1, 1), ("n", 2, 2)}
