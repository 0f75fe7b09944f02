import pytest

from alinea.llm.confusables import Prototypes, disguised, look_alikes, part_form, skeleton, skeleton_groups


@pytest.fixture(scope="module")
def look(spark):
    return Prototypes(look_alikes(spark))


SAME = [
    ("ｅｘｃｅｐｔ；５", "except;5"),
    ("ﬁle oﬃce", "file office"),
    ("résumé", "résumé"),
    ("a​b­c﻿d⁠", "abcd"),
    ("a b c d　e\tf", "a b c d e f"),
    ("соrе οіѕ", "core ois"),
    ("Іdentity АΒ", "Identity AB"),
    ("“amber” – don’t", "\"amber\" - don't"),
    ("ɑɡıle", "agile"),  # of the same script
    ("Λ", "Л"), ("ロ", "口"), ("ʍ", "м"), ("·", "•"), ("3∶4", "3:4"),  # between other scripts, and symbols
    ("Œuvre œ", "OEuvre oe"),  # several characters
]
DIFFERENT = [("Core", "core"), ("resume", "résumé"), ("O1", "01"), ("l", "I"), ("l", "1"), ("rn", "m"), ("10²", "102"), ("①", "1"), ("a b", "ab"), ("і", "I"), ("", "x"), ("Ө", "ө"), ("٣", "3"), ("Λ", "A"), ("ă", "a"), ("ø", "o"), ("Ж", "ж")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(look, a, b):
    assert skeleton(a, look) == skeleton(b, look)
    assert skeleton(skeleton(a, look), look) == skeleton(a, look)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_real_differences(look, a, b):
    assert skeleton(a, look) != skeleton(b, look)


def test_parts_end_at_whole_letters(look):
    whole = part_form(skeleton("un café ḕ̱ noir", look))
    assert part_form(skeleton("cafe", look)) not in whole
    assert part_form(skeleton("café ", look)) in whole
    assert part_form(skeleton("e", look)) not in part_form(skeleton("ḕ̱", look))
    assert skeleton(None, look) is None and part_form(None) is None


def test_disguised(spark):
    items = [
        (1, "A", "the ﬁle", True), (1, "A", "the ﬁle", True),  # twice
        (2, "A", "the file", True),  # as it stands
        (3, "A", "ﬁle", True),  # not the whole
        (4, "A", "ﬁle", False),
        (5, "A", "le", False),  # a part as it stands
        (6, "A", "File", False), (7, None, "ﬁle", False), (8, "Z", "ﬁle", False), (9, "A", None, False), (10, "A", "", False), (11, "A", "​", False),
        (12, "B", "ｘ" * 200_000, True),
    ]
    left = spark.createDataFrame([(*x, 0, 0) for x in items], "source_id int, key string, value string, whole boolean, source int, _look int")
    right = spark.createDataFrame([("A", "the file", 1), ("A", "the file", 2), ("A", "other", 3), ("B", "x" * 200_000, 4), (None, "ﬁle", 5), ("A", None, 6)], "key string, source string, value int")
    for hot in (250_000, 2):
        assert sorted(r.source_id for r in disguised(left, right, hot).collect()) == [1, 1, 4, 12]
    assert disguised(left.limit(0), right).count() == disguised(left, right.limit(0)).count() == 0


def test_groups(spark):
    rows = [("office",), ("oﬃce",), ("office",), ("Office",), (None,), ("",)]
    got = skeleton_groups(spark.createDataFrame(rows, "text string"), "text").collect()
    assert [tuple(r) for r in got] == [("office", 3, 2)]


def test_the_table_is_read_once_a_session(spark):
    assert look_alikes(spark) is look_alikes(spark)
    assert not any(c < 128 for c in look_alikes(spark))
