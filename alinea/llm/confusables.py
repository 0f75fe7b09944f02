"""Problem 4: texts that look the same brought to one form, the skeleton.

A text is decomposed, each character replaced by its prototype, and the result decomposed again; two texts look the
same if their skeletons are equal. Prototypes:

- invisible characters (default ignorable ones and format controls): nothing;
- every kind of white space: a plain space;
- compatibility forms that only differ in width, font, ligature or line breaking: their plain characters;
- typographic quotes and dashes: the plain ones (the data below equate some with other marks, so these few are listed);
- any other letter, mark of punctuation or symbol: what the Unicode confusables data in Spark's own ICU library equate it
  with (see ``look_alikes``), whether in another script, in the same one, or several characters.

ASCII characters are never replaced (the data equate I, l, 1 and |, or m and rn). Kept apart by rule, as the difference is
real: letters that differ in case only; digits and other numbers, other than by compatibility; accents and other
combining marks; raised, lowered, circled and squared forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alinea.functions.keys import norm_key
from alinea.plans.skew import skew_join
from alinea.plans.unions import union_all
from alinea.sources.tables import table

#: Typographic quotes and dashes and what stands for them.
PUNCTUATION = {
    "'": "‘’‚‛′ʼ‵",
    '"': "“”„‟″‶",
    "-": "‐‑‒–—―−⁃",
}
#: Kinds of compatibility decomposition that keep a character's look. Raised, lowered, circled and
#: squared characters and fractions look different and are kept.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
_BLANK = regex.compile(r"\p{White_Space}")
_MARKED = regex.compile(r"\P{M}\p{M}+|\p{M}+")


_TABLES: dict[str, dict[int, str]] = {}


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Characters that ICU's confusables data equate with others, and their prototypes. Read once a session, on the driver.

    Characters with equal ICU skeletons form a class. The prototype is the class's ASCII character, of several the one
    of the same case or kind, else the skeleton itself. In a class without ASCII, letters that are each other's upper and
    lower case stay themselves.
    """
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        _TABLES[app] = _table(lambda chars: checker.getSkeleton("\n".join(chars)).split("\n"))
    return _TABLES[app]


def _table(skeletons: Callable[[list[str]], list[str]]) -> dict[int, str]:
    ascii_ = [chr(c) for c in range(33, 127)]
    # Characters that decompose are treated by their parts.
    others = [x for x in map(chr, range(128, 0x20000)) if unicodedata.category(x)[0] in "LPS" and not unicodedata.decomposition(x) and not _INVISIBLE.match(x) and not "\uac00" <= x <= "\ud7a3"]
    shapes = skeletons(ascii_ + others)
    by_shape: dict[str, list[str]] = {}
    for x, shape in zip(ascii_, shapes):
        by_shape.setdefault(shape, []).append(x)
    classes: dict[str, set[str]] = {}
    for x, shape in zip(others, shapes[len(ascii_) :]):
        classes.setdefault(shape, set()).add(x)
    out = {}
    for x, shape in zip(others, shapes[len(ascii_) :]):
        same = by_shape.get(shape, [])
        kind = unicodedata.category(x)
        fit = [a for a in same if unicodedata.category(a) == kind] or [a for a in same if unicodedata.category(a)[0] == kind[0]] or same
        if fit:
            out[ord(x)] = fit[0]
        elif shape != x and not ({x.upper(), x.lower()} - {x}) & classes[shape]:
            out[ord(x)] = shape.replace("rn", "m")  # the data's form of m, which stays itself here
    return out


class Prototypes(dict):
    """A table for str.translate: ASCII is itself, white space a space; other entries are made when first met. ``letters`` are the look-alikes."""

    def __init__(self, letters: dict[int, str]):
        super().__init__({c: c for c in range(128)} | {c: " " for c in (9, 10, 11, 12, 13)})
        self.letters = letters
        self.plain = {ord(x): a for a, many in PUNCTUATION.items() for x in many}

    def __missing__(self, c: int):
        x = chr(c)
        if c in self.plain:
            y = self.plain[c]
        elif _INVISIBLE.match(x):
            y = ""
        elif _BLANK.match(x):
            y = " "
        elif c in self.letters:
            y = self.letters[c]
        elif unicodedata.decomposition(x).partition(" ")[0] in SAME_LOOK:
            y = "".join(chr(int(h, 16)) for h in unicodedata.decomposition(x).split()[1:]).translate(self)
        else:
            y = x
        self[c] = y
        return y


def skeleton(text: str | None, prototypes: Prototypes) -> str | None:
    """The skeleton of ``text``; null for null. Long texts are treated whole."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(prototypes) if any(b in text for b in "\t\n\v\f\r") else text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes))


def part_form(skeleton_: str | None) -> str | None:
    """A skeleton in which a part never ends between a letter and its accents: a marked letter without a composed form of its own
    is written in private characters, so that its base letter is no part of it."""
    if skeleton_ is None or skeleton_.isascii():
        return skeleton_
    whole = unicodedata.normalize("NFC", skeleton_)
    return _MARKED.sub(lambda m: "\x01" + "".join(chr((0xF0000 if ord(c) < 0x10000 else 0x100000) + (ord(c) & 0xFFFF)) for c in m[0]) + "\x01", whole)


def skeleton_column(spark: SparkSession, c: Column | str, parts: bool = False) -> Column:
    """``skeleton`` of a text column by Arrow batches; with ``parts`` in the form whose substrings are its visible parts."""
    letters = look_alikes(spark)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prototypes = Prototypes(letters)
        for s in batches:
            yield s.map(lambda x: (part_form(skeleton(x, prototypes)) if parts else skeleton(x, prototypes)) if isinstance(x, str) else None)

    return run(F.col(c) if isinstance(c, str) else c)


def skeleton_groups(df: DataFrame, text: str) -> DataFrame:
    """``skeleton, n_rows, n_forms`` for each skeleton that more than one different text of the table has.

    Repeated texts are counted before their skeletons are made. Null texts belong to no group.
    """
    counted = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    made = counted.select(skeleton_column(df.sparkSession, "form").alias("skeleton"), "n")
    return made.groupBy("skeleton").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")


def disguised(items: DataFrame, sources: DataFrame, hot_rows: int = 250_000) -> DataFrame:
    """The rows of ``items`` that are no text of their source as it stands, yet look the same as it or a part of it.

    ``items``: ``key, value, whole`` and any other columns, all of which are kept; with ``whole`` the value must look like all of the source, else like a part. ``sources``: ``key, source``; a key may
    have several texts, and any will do. Null or empty values, null keys and keys without a source give no row, nor do
    values of invisible characters only. Repeated items stay repeated.
    """
    spark = items.sparkSession
    texts = sources.select("key", "source").where(F.col("key").isNotNull() & F.col("source").isNotNull()).distinct()
    texts = texts.withColumn("_shape", skeleton_column(spark, "source", True))
    texts = texts.groupBy("key").agg(F.collect_list(F.struct("source", "_shape")).alias("_texts"))
    rows = items.where(F.col("key").isNotNull() & (F.col("value") != "")).select(F.struct("*").alias("_row"), "key", "value", "whole", skeleton_column(spark, "value", True).alias("_look"))
    met = skew_join(rows, texts, ["key"], "inner", None, hot_rows)
    exact = F.exists("_texts", lambda t: F.when(F.col("whole"), t["source"] == F.col("value")).otherwise(F.contains(t["source"], F.col("value"))))
    alike = F.exists("_texts", lambda t: F.when(F.col("whole"), t["_shape"] == F.col("_look")).otherwise(F.contains(t["_shape"], F.col("_look"))))
    return met.where((F.col("_look") != "") & ~exact & alike).select("_row.*")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts of findings_sample that differ from their source in their characters only."""
    lines = table(spark, d, "findings_sample").select("line_no", norm_key("clause_id").alias("clause"), "clause_text", "findings")
    each = lines.select("line_no", "clause", F.posexplode("findings").alias("_at", "f"))
    place = (F.col("_at") + 1).cast("int").alias("finding_no")
    of_clause = lines.select("line_no", F.lit(0).alias("finding_no"), F.lit("clause_text").alias("field"), F.col("clause").alias("key"), F.col("clause_text").alias("value"), F.lit(True).alias("whole")).unionByName(
        each.select("line_no", place, F.lit("evidence_sama").alias("field"), F.col("clause").alias("key"), F.col("f.evidence_sama").alias("value"), F.lit(False).alias("whole"))
    )
    of_control = each.select("line_no", place, F.lit("evidence_nist").alias("field"), norm_key("f.control_id").alias("key"), F.col("f.evidence_nist").alias("value"), F.lit(False).alias("whole"))
    clauses = table(spark, d, "clauses").select(norm_key("clause_id").alias("key"), F.col("text").alias("source"))
    controls = table(spark, d, "controls").select(norm_key("control_id").alias("key"), F.col("statement").alias("source"))
    return union_all([disguised(of_clause, clauses), disguised(of_control, controls)]).select("line_no", "finding_no", "field")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of different spellings with one skeleton among all clause texts, statements and texts of the findings."""
    lines = table(spark, d, "findings_sample")
    texts = lines.select(F.col("clause_text").alias("text"))
    for c in ("evidence_sama", "evidence_nist"):
        texts = texts.unionAll(lines.select(F.explode(f"findings.{c}").alias("text")))
    texts = texts.unionAll(table(spark, d, "clauses").select("text")).unionAll(table(spark, d, "controls").select("statement"))
    return skeleton_groups(texts, "text")


def queries() -> dict:
    return {"p4_found": p4_found, "p4_groups": p4_groups}


def oracle_sql() -> dict[str, str]:
    return {}
