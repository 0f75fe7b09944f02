"""Keys as they are compared: without surrounding blanks, regardless of letter case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def norm_key(c: Column | str) -> Column:
    """``c`` trimmed of any Unicode blank and in upper case; null for a null or blank key."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def norm_category(c: Column | str) -> Column:
    """``c`` in lower case without blanks, hyphens and underscores; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.regexp_replace(c, r"(?U)[\s_-]+", ""))
    return F.when(bare != "", bare)
