import os

import pytest
from hypothesis import given, settings, strategies as st

from alinea.llm.bpe import tokenizer_path, transducer
from alinea.llm.pieces import Limit, SLACK, borders, cut, pieces, read_limits, split_oversized

PATH = tokenizer_path("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
TEXT = st.lists(st.sampled_from(["word ", "Überwachung ", "x" * 30, "end. ", "a; b, ", "\n", "\n\n", "日本語。", "😀", "​", "  ", "12.5 ", "don't", "'s", "!?\" "]), max_size=120).map("".join)


def check(text, limit):
    t = transducer(PATH)
    b, n = borders(text, t), len(t.encode(text))
    assert len(b.char) == len(b.pause) == n + 1 and b.char[-1] == len(text)
    got = list(pieces(text, limit, t, b))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for x, y, size, shared, _ in got:
        assert size == len(t.encode(text[x:y])) <= limit.max_tokens
        assert x < y and 0 <= shared <= limit.overlap + SLACK
    for (x, y, *_), (x2, y2, _, shared, _) in zip(got, got[1:]):
        assert x <= x2 <= y < y2
        assert (x2 == y) == (shared == 0)
    return got


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from([Limit("a", 12, 0), Limit("b", 16, 4), Limit("c", 40, 20)]))
def test_pieces_cover_the_text_within_the_limit(text, limit):
    if len(transducer(PATH).encode(text)) > limit.max_tokens:
        check(text, limit)


def test_exact_overlap_and_natural_ends():
    text = "\n\n".join(" ".join(f"The steward shall review item {i}-{j}." for j in range(6)) for i in range(40))
    t = transducer(PATH)
    got = check(text, Limit("x", 128, 16))
    ids = t.encode(text)
    assert len(got) > 20
    assert all(shared == 16 for *_, shared, _ in got[1:])
    assert {end for *_, end in got} <= {5, 7, 8}  # sentences, paragraphs, the end
    for (_, y, *_), (x2, _, _, shared, _) in zip(got, got[1:]):
        assert t.encode(text[x2:])[: shared] == ids[len(ids) - len(t.encode(text[x2:])):][: shared]


def test_weakest_pause_is_merged_first():
    t = transducer(PATH)
    text = "one two three, four five six. seven eight nine, ten eleven twelve."
    b = borders(text, t)
    parts = cut(b, Limit("x", 9, 0))
    assert [text[b.char[x] : b.char[y]] for x, y in zip(parts, parts[1:])] == ["one two three, four five six.", " seven eight nine, ten eleven twelve."]


@pytest.mark.parametrize("text", ["a" * 30_000, "日本" * 4_000, "😀" * 3_000, " " * 20_000, "\n" * 5_000, "word " * 20_000, "x. " * 20_000])
def test_long_texts(text):
    check(text, Limit("x", 256, 32))


def test_column(spark):
    long = "Each unit shall log keys. " * 60
    rows = [(1, long, "c"), (1, long, "c"), (2, None, "c"), (3, "", "c"), (4, "short", "c"), (None, long, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = split_oversized(df, "doc_id", "text", [Limit("s", 64, 8), Limit("w", 10_000, 8)]).collect()
    assert {r.doc_id for r in got} == {1, None} and {r.limit_name for r in got} == {"s"}
    assert all(r.piece == long[r.start_char : r.end_char] for r in got)
    assert len([r for r in got if r.doc_id == 1]) == 2 * len([r for r in got if r.doc_id is None])
    assert split_oversized(df.limit(0), "doc_id", "text", [Limit("s", 64, 8)]).count() == 0
    assert split_oversized(df, "doc_id", "text", []).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "doc_id", "text", [Limit("s", 10, 8)])


def test_settings(spark):
    spec = "limit_name string, used_for string, tokenizer string, max_tokens int, overlap_tokens int"
    rows = [("a", "piece", "byte_bpe_50k", 50, None), ("b", "piece", " ", 60, 7), ("c", "container", "x", 7, None), ("d", "piece", "other", 60, 0)]
    assert sorted(read_limits(spark.createDataFrame(rows, spec))) == [Limit("a", 50, 0), Limit("b", 60, 7), Limit("d", 60, 0, "other.json")]
    with pytest.raises(ValueError):
        read_limits(spark.createDataFrame([(str(k), "piece", "x", 50, None) for k in range(1001)], spec))
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([(1, "x")], "doc_id int, text string"), "doc_id", "text", [Limit("a", 50, 0), Limit("a", 60, 0)])
