import functools
import os

import pytest
from hypothesis import given, settings, strategies as st

tokenizers = pytest.importorskip("tokenizers")

from alinea.llm.bpe import PATTERN, Merges, Transducer, Utf8Machine, decode_stream, tokenizer_path, transducer
from alinea.llm.encoding import count_column, decode_column, encode_column

PATH = tokenizer_path("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@functools.cache
def _library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture
def library():
    return _library()


TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="aabeehtinsr '\n\t.,;<|>0129éßя日​ 　́", max_size=60))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_the_librarys_and_decode_again(text):
    ids = transducer(PATH).encode(text)
    assert ids == _library()(text)
    assert "".join(decode_stream(transducer(PATH).merges, ids)) == text


def test_special_empty_null_and_long(library):
    enc = transducer(PATH).encode
    assert enc(None) == enc("") == []
    assert enc("<|endoftext|>") == library("<|endoftext|>") != [50256]
    for s in ("a" * 50_000, "é" * 20_000, " " * 30_000 + "x", "日本" * 10_000, "word " * 20_000):
        assert enc(s) == library(s)


def test_bounded_tables_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr("alinea.llm.bpe.MAX_STATES", 50)
    monkeypatch.setattr("alinea.llm.bpe.MAX_PARTS", 20)
    t = Transducer(Merges.load(PATH))
    text = " ".join(f"supervisory{i} Überwachung {i * 7919} résumé" for i in range(300))
    assert t.encode(text) == library(text)


def test_streaming_settles_before_the_end():
    t = transducer(PATH)
    out, state, waits = [], t.start, []
    for b in ("responsibilities" * 200).encode():
        state = t.feed(state, bytes((b,)), out)
        waits.append(len(state.bytes))
    assert max(waits) < 2 * t.merges.longest and out
    t.finish(state, out)
    assert out == t.encode("responsibilities" * 200)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine_equals_the_librarys_decoder(data, cut):
    m = Utf8Machine()
    got = "".join(m.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + m.finish()
    assert got == data.decode("utf-8", "replace")


def test_rank_file_gives_the_same_vocabulary():
    a, b = Merges.load(PATH), Merges.load(tokenizer_path("byte_bpe_50k.tiktoken"))
    text = "The Zürnau clearing house shall re-certify 1,024 signing keys\n\n within 24 hours."
    assert len(a.rank) == len(b.rank) and Transducer(a).encode(text) == Transducer(b).encode(text)


def test_column(spark, library):
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "tie", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_column(df, "doc_id", "text").collect())
    assert got == [(0, library("tie")), (1, library("Hello  world")), (2, []), (3, []), (3, [])]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_column(df, "doc_id", "text").collect()) == [(0, 1), (1, 3), (2, 0), (3, 0), (3, 0)]


def test_decode_column(spark):
    texts = ["one two", "", None, "é‍👩‍🚀 \x00 <|endoftext|>", "x" * 5000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    back = decode_column(encode_column(df, "doc_id", "text"), "doc_id", "ids")
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t or "" for t in texts]
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r.text for r in decode_column(lists, "doc_id", "ids").collect()] == ["", ""]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs"]), max_size=80)))
def test_split_and_count_are_those_of_the_full_engine(text):
    import regex

    t = transducer(PATH)
    assert t.split(text) == regex.compile(PATTERN).findall(text)
    assert t.count(text) == len(t.encode(text))


def test_split_of_every_character():
    import regex

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a, z in (("", ""), ("a", "1"), (" ", "a"), (".", " ")):
        for at in range(0, len(every), 50_000):
            text = "".join(f"{a}{x}{z}" for x in every[at : at + 50_000])
            assert transducer(PATH).split(text) == regex.compile(PATTERN).findall(text)
