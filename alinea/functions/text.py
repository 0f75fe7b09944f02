"""Text functions as columns: tokens, patterns, normal forms, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Token pattern (identifiers before plain words), words that are no tokens, and the patterns that mark
#: modal verbs, references to other texts, concrete values, control identifiers, and what a list item that states
#: something itself has. Digits are spelt [0-9], as \d means other characters in the regex dialects that read these.
TOKEN = r"[A-Za-z]{2}-[0-9]{1,2}\([0-9]{1,2}\)(?:\([0-9]{1,2}\))?|[A-Za-z]{2}-[0-9]{1,2}|[0-9]+(?:\.[0-9]+){1,3}[a-z]?|[A-Za-z][A-Za-z0-9']+"
STOP = "the a an and or of to in for on at by with as is are be been was were this that these those it its which from such any all".split()
MODAL = r"(?i)\b(should|shall|must|may)\b"
REFERENTIAL = r"(?i)(please\s+refer\s+to|refer\s+to\s+the|see\s+appendix|as\s+defined\s+in\s+the)"
VALUE = r"(?i)\b(quarterly|annual(?:ly)?|monthly|weekly|daily|bi-annual(?:ly)?|twice\s+a\s+year|24x7|24/7|[0-9]+\s+successive|[0-9]+\s+consecutive|at\s+least\s+[0-9]+|[0-9]+\s+days?|[0-9]+\s+months?|[0-9]+\s+years?)\b"
IDENTIFIER = r"[A-Za-z]{2}-[0-9]{1,2}(?:\([0-9]{1,2}\))?"
STATES = r"(?i)\b(is|are|was|were|be|been|shall|should|must|may|will|can)\b|\b\w+(?:ing|ed|es|s)\b\s+(?:for|to|by|with|in|on|that|the)\b"
TYPOGRAPHIC = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " "}
#: Evidence with fewer normalised characters is none; z of the 95 % interval.
MIN_EVIDENCE, Z95 = 15, 1.96


def tokens(c: Column | str) -> Column:
    """Tokens of a text in order, with repeats, in lower case, without stop words; empty for null."""
    found = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    low = F.transform(F.coalesce(found, F.array().cast("array<string>")), F.lower)
    return F.filter(low, lambda t: ~t.isin(STOP) & (F.length(t) > 1))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clip(c: Column | str, most: int) -> Column:
    """A collapsed text; if it is longer than ``most``, its first ``most`` characters up to the last blank in them (all, without one) and an ellipsis."""
    flat = collapse(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", ""), F.lit("…")))


def modal(c: Column | str) -> Column:
    """The first modal verb in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(c, MODAL, 1)), F.lit(""))


def values(c: Column | str) -> Column:
    """Concrete values and periods: distinct, collapsed, lower case, sorted."""
    found = F.regexp_extract_all(c, F.lit(VALUE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(collapse(x)))))


def enumerative(text: Column, inherits: Column) -> Column:
    """Whether a text is a list item that states nothing itself: it takes its modal verb from above (``inherits``), is short, ends like an item, and has no verb of its own."""
    bare = F.trim(text)
    listed = inherits & (F.length(bare) < 70) & bare.rlike(r"[;.]$") & ~bare.rlike(STATES)
    return F.coalesce(listed, F.lit(False))


def identifiers(c: Column | str) -> Column:
    """Control-like identifiers in upper case, with repeats."""
    return F.transform(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)), F.upper)


@F.pandas_udf(StringType())  # no DDL: the module must import without a session
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def norm(c: Column | str, ascii_only: bool = False) -> Column:
    """The form in which evidence is compared: NFKC, plain quotes and dashes, collapsed, lower case; empty for null.

    Spark has no NFKC, so it comes from an Arrow function; ``ascii_only`` leaves it out where texts are known to be ASCII.
    """
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    if not ascii_only:
        x = _nfkc(x)
    return F.lower(collapse(F.translate(x, "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))))


def fingerprint(ordered: Column) -> Column:
    """First 16 hex digits of the SHA-256 of an array of strings, joined."""
    return F.substring(F.sha2(F.array_join(ordered, ""), 256), 1, 16)


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """A bound of the 95 % Wilson interval of ``hits`` in ``n``; 0 for no trials."""
    z2 = Z95 * Z95
    p, d = hits / n, 1 + z2 / n
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / d
    centre = (p + z2 / (2 * n)) / d
    bound = F.least(F.lit(1.0), centre + half) if upper else F.greatest(F.lit(0.0), centre - half)
    return F.when(n == 0, 0.0).otherwise(bound)


def natural_key(c: Column | str) -> Column:
    """Dotted numbers as an array of integers, which sorts 3.2.10 behind 3.2.9."""
    return F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
