import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from alinea.operators.records import decode, drift, encode, matching, near_matches, problems, repeated_sentences, repeats, tallies
from alinea.sources import files
from alinea.streaming.resume import latest, resume, still_to_do


def test_decode_and_encode(spark):
    df = spark.createDataFrame([(" x ", "a; b;;", "1; two", "YES", "2025.0"), ("", None, "", "no", "n/a")], "name string, tags string, nums string, flag string, year string")
    out = decode(df, {"tags": "string", "nums": "int"}, ("flag",), ("year",))
    a, b = out.collect()
    assert (a.name, a.tags, a.nums, a.flag, a.year) == ("x", ["a", "b"], [1, None], True, 2025)
    assert (b.name, b.tags, b.flag, b.year, b.raw_year) == (None, None, False, None, "n/a")
    e = encode(out.select("name", "tags", "flag", "year")).first()
    assert tuple(e) == ("x", "a;b", "true", "2025")


SCHEMA = {
    "required": ["id", "tags", "absent"],
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "day": {"type": "string", "format": "date"},
        "kind": {"type": "string", "enum": ["x", "y"]}, "tags": {"type": "array", "items": {"type": "string", "enum": ["p", "q"]}, "uniqueItems": True}, "flag": {"type": "boolean"}, "wrong": {"type": "integer"},
    },
}


def test_rules(spark):
    kind = "id string, n int, day string, kind string, tags array<string>, flag boolean, wrong string, extra int"
    rows = [("ab", 5, "2024-01-02", "x", ["p", "q"], True, None, None), ("A", 0, "2024", "z", ["p", "p", "r"], None, "1", 3), (None, 10, None, None, [], None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.select(problems(SCHEMA, df.dtypes)).collect()]
    assert got[0] == ["missing absent"]
    assert got[1] == ["missing absent", "id: pattern", "id: too short", "n: below minimum", "day: no date", "kind: not in list", "tags: item not in list", "tags: duplicates", "wrong: no integer", "unknown extra"]
    assert got[2] == ["missing id", "missing tags", "missing absent", "n: above maximum"]
    assert problems({}, [("a", "int")]) is not None


def test_repeats_drift_tallies(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 1), ("b", 2), (None, 1), (None, 2)], "k string, at int")
    assert [tuple(r) for r in repeats(df, "k", "at").collect()] == [("a", 3, 1)]
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "x")], "id int, h string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (5, "n")], "id int, h string")
    assert {r.id: r.state for r in drift(old, new, "id", "h").collect()} == {1: "unchanged", 2: "changed", 3: "new", 4: "missing", 5: "new"}
    t = spark.createDataFrame([("a", ["x", "x"]), (None, []), ("a", None)], "c string, l array<string>")
    assert {(r.field, r.value): r.n for r in tallies(t, ["c", "l"]).collect()} == {("c", "a"): 2, ("c", None): 1, ("l", "x"): 2}


def test_repeated_sentences(spark):
    rows = [("One two. Three? one  two.", True), ("One. Two. ", False), (None, False), ("", False), ("1.5 and 1.5", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", repeated_sentences("t").alias("got")).collect())


def test_look_ups(spark):
    df = spark.createDataFrame([("AC-1",), (" ac-10 ",), (None,), ("B",)], "k string")
    assert matching(df, "k", None).count() == 4
    assert [r.k for r in matching(df, "k", ["ac-1 ", "b"]).collect()] == ["AC-1", "B"]
    assert [r.k for r in near_matches(df, "k", "Ac", 1).collect()] == [" ac-10 "]


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi",\nthere', [1, 2], True, None)], "id string, t string, l array<int>, f boolean, z string")
    files.write_csv(df, f"{tmp_path}/c")
    got = files.read_csv(spark, f"{tmp_path}/c").first()
    assert (got.id, got.t, got.l, got.f) == ("a", 'say "hi",\nthere', "1;2", "true")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,t\n1,x\n")
    assert files.read_csv(spark, f"{tmp_path}/bom.csv").columns == ["id", "t"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert sorted(tuple(r) for r in files.read_json_lines(spark, f"{tmp_path}/l.jsonl", "a int, b string").collect()) == [(1, None), (2, "x")]
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{tmp_path}/none.jsonl", "a int").count()
    files.write_json_lines(df, f"{tmp_path}/j")
    assert json.loads("".join(x.read_text() for x in (tmp_path / "j").glob("part*")))["z"] is None
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "DOC-1.txt").write_text("<<<PAGE 1>>>\nx\n")
    assert [tuple(r) for r in files.read_marked_text(spark, f"{tmp_path}/t").collect()] == [("DOC-1", "<<<PAGE 1>>>\nx\n")]


def test_pdf_and_download(spark, tmp_path):
    data = spark.createDataFrame([("a.pdf", bytearray(b"one|two")), ("bad.pdf", bytearray(b"!"))], "path string, content binary")

    def reader():
        def read(b):
            if b == b"!":
                raise ValueError
            return b.decode().split("|")
        return read

    assert sorted(map(tuple, files.pdf_pages(data, reader).collect())) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    assert sorted(map(tuple, files.page_counts(data, reader).collect())) == [("a.pdf", 2), ("bad.pdf", 0)]

    def opener(url):
        if "gone" in url:
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        if "down" in url:
            raise OSError
        return b"body", 200, "text/html"

    rows = spark.createDataFrame([(1, "http://ok"), (2, "http://gone"), (3, "http://down"), (4, None)], "id int, url string")
    got = {r.id: (r.content and bytes(r.content), r.status) for r in files.download(rows, "id", "url", opener, pause=0).collect()}
    assert got == {1: (b"body", 200), 2: (None, 404), 3: (None, 0)}
    before = spark.createDataFrame([(1, "old"), (2, None), (5, "x")], "id int, sha256 string")
    assert sorted(tuple(r) for r in files.fetch_states(files.download(rows, "id", "url", opener, pause=0), before, "id").select("id", "state").collect()) == [(1, "drifted"), (2, "failed"), (3, "failed")]
    same = files.fetch_states(files.download(rows, "id", "url", opener, pause=0), files.download(rows, "id", "url", opener, pause=0), "id")
    assert {r.id: r.state for r in same.collect()}[1] == "ok"
    kept = files.keep_raw(files.download(rows, "id", "url", opener, pause=0).withColumn("format", F.lit("html")), "id", "content", "format", str(tmp_path)).collect()
    assert [(r.id, r.bytes) for r in kept] == [(1, 4)] and (tmp_path / "1.html").read_bytes() == b"body"
    assert files.keep_raw(files.download(rows, "id", "url", opener, pause=0).withColumn("format", F.lit("unknown")), "id", "content", "format", str(tmp_path)).first().path == f"{tmp_path}/1.bin"
    held = spark.createDataFrame([(1,)], "id int")
    assert sorted(r.id for r in files.still_to_fetch(rows, held, "id", "url").collect()) == [2, 3]
    assert files.still_to_fetch(rows, held, "id", "url", force=True).count() == 3


def test_vectors(spark, tmp_path):
    spark.createDataFrame([(1, [0.5, 1.0], "x"), (2, None, "y")], "k int, v array<double>, c string").write.parquet(f"{tmp_path}/v")
    got = files.read_vectors(spark, f"{tmp_path}/v", "k", "v")
    assert dict(got.dtypes)["v"] == "array<float>" and [(r.k, r.v) for r in got.collect()] == [(1, [0.5, 1.0])]


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [files.cached(make, f"{tmp_path}/v", fp, spark).count() for fp in ("a", "a", "b")] == [3, 3, 3] and len(made) == 2


def test_resume(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id string, v int"

    def make(df):
        return df.withColumn("error", F.when(F.col("v") < 0, "failed").otherwise(""))

    def run():
        q = resume(spark.readStream.schema(schema).parquet(source), make, out, check, "id")
        q.awaitTermination()
        return sorted((r.id, r.v, r.error) for r in spark.read.parquet(out).collect())

    spark.createDataFrame([("a", 1), ("b", -1), ("a", 1), (None, 5)], schema).write.parquet(source)
    assert run() == [("a", 1, ""), ("b", -1, "failed")]
    spark.createDataFrame([("a", 9), ("b", 2), ("c", 3)], schema).write.mode("append").parquet(source)
    assert run() == [("a", 1, ""), ("b", -1, "failed"), ("b", 2, ""), ("c", 3, "")]
    assert run() == [("a", 1, ""), ("b", -1, "failed"), ("b", 2, ""), ("c", 3, "")]
    done = spark.read.parquet(out)
    assert sorted((r.id, r.v, r.error) for r in latest(done, "id").collect()) == [("a", 1, ""), ("b", 2, ""), ("c", 3, "")]
    rows = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in still_to_do(rows, done, "id").collect()] == ["z"]
