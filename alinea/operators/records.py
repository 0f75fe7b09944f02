"""Records of a register: typed decoding and encoding, rule checks, duplicates, hashes, tallies."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from alinea.plans.unions import union_all


def decode(df: DataFrame, lists: dict[str, str] | None = None, booleans: tuple[str, ...] = (), integers: tuple[str, ...] = ()) -> DataFrame:
    """Text columns typed: trimmed, empty as null; lists split at ``;`` (to their element type), booleans, whole numbers.

    Whole numbers may be written as 2025.0. A value that can't be cast is null; its text stays in ``raw_<column>``.
    """
    lists = lists or {}
    out = []
    for c in df.columns:
        text = F.nullif(F.trim(F.col(c)), F.lit(""))
        if c in lists:
            items = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
            out += [_cast_items(items, lists[c]).alias(c), text.alias(f"raw_{c}")]
        elif c in booleans:
            out += [F.lower(text).isin("true", "yes", "1", "y").alias(c), text.alias(f"raw_{c}")]
        elif c in integers:
            out += [text.try_cast("double").cast("bigint").alias(c), text.alias(f"raw_{c}")]
        else:
            out.append(text.alias(c))
    return df.select(*out)


def _cast_items(items: Column, kind: str) -> Column:
    return F.transform(items, lambda x: x.try_cast(kind))


def encode(df: DataFrame) -> DataFrame:
    """All columns as text: arrays joined by ``;``, booleans as true and false, null as empty."""
    out = []
    for c, kind in df.dtypes:
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), ";") if kind.startswith("array") else F.col(c).cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(c))
    return df.select(*out)


def problems(schema: dict, columns: list[tuple[str, str]]) -> Column:
    """What is wrong with a row by a JSON-Schema-like ``schema``, as an array of messages: compiled into native expressions.

    Known rules: required, properties with type (string, integer, boolean, array), enum, pattern, minLength, minimum,
    maximum, format date, items and uniqueItems; columns that the schema doesn't name are reported for rows that fill them.
    """
    found: list[Column] = []
    types = dict(columns)
    for c in schema.get("required", []):
        empty = F.lit(True) if c not in types else F.col(c).isNull() | ((F.col(c) == "") if types[c] == "string" else (F.size(c) == 0) if types[c].startswith("array") else F.lit(False))
        found.append(F.when(empty, F.lit(f"missing {c}")))
    for c, kind in columns:
        spec = schema.get("properties", {}).get(c)
        if spec is None:
            found.append(F.when(F.col(c).isNotNull(), F.lit(f"unknown {c}")))
            continue
        found += [F.when(F.col(c).isNotNull() & bad, F.lit(f"{c}: {what}")) for what, bad in _rules(F.col(c), kind, spec)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _rules(c: Column, kind: str, spec: dict) -> list[tuple[str, Column]]:
    wanted = spec.get("type")
    names = {"string": ("string",), "integer": ("int", "bigint", "smallint", "tinyint"), "boolean": ("boolean",)}
    if wanted == "array" and kind.startswith("array<"):
        inner = spec.get("items", {})
        out = [(f"item {w}", F.exists(c, _nested(kind[6:-1], inner, i))) for i, (w, _) in enumerate(_rules(F.lit(None).cast(kind[6:-1]), kind[6:-1], inner))]
        return out + [("duplicates", F.size(F.array_distinct(c)) < F.size(c))] * bool(spec.get("uniqueItems"))
    if wanted in names and kind not in names[wanted] or wanted == "array":
        return [(f"no {wanted}", F.lit(True))]
    out = []
    if "enum" in spec:
        out.append(("not in list", ~c.isin(spec["enum"])))
    if "pattern" in spec:
        out.append(("pattern", ~c.rlike("^(?:" + spec["pattern"].removeprefix("^") + ")")))
    if "minLength" in spec:
        out.append(("too short", F.length(c) < spec["minLength"]))
    if "minimum" in spec:
        out.append(("below minimum", c < spec["minimum"]))
    if "maximum" in spec:
        out.append(("above maximum", c > spec["maximum"]))
    if spec.get("format") == "date":
        out.append(("no date", ~c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")))
    return out


def _nested(kind: str, spec: dict, i: int):
    return lambda x: _rules(x, kind, spec)[i][1]


def matching(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Rows whose ``column`` is one of ``values``, regardless of case and blanks around; all rows without values."""
    if not values:
        return df
    return df.where(F.lower(F.trim(column)).isin([v.strip().lower() for v in values]))


def near_matches(df: DataFrame, column: str, value: str, most: int = 10) -> DataFrame:
    """Up to ``most`` rows whose ``column`` contains ``value``, regardless of case, in order: what a failed look-up suggests."""
    return df.where(F.contains(F.lower(column), F.lit(value.strip().lower()))).orderBy(column).limit(most)


def repeats(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose key an earlier row (by ``at``) has, with ``first_at``. Found by a map-side combined minimum, not by sorting a key's rows.

    Of rows with the same key and place, all but none is earlier: these are no repeats of each other.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("first_at"))
    return df.join(first, key).where(F.col(at) > F.col("first_at"))


def drift(recorded: DataFrame, held: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, state``: unchanged, changed, missing (recorded only), new (held only or without a recorded digest)."""
    a, b = recorded.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_ra")), held.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_rb"))
    state = F.when(F.col("_rb").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


#: Formats by the first bytes, what a content type has in it, and how an address ends; the first that fits.
FORMATS = [
    ("pdf", "%PDF-", "pdf", (".pdf",)),
    ("html", None, "html", (".html", ".htm", "/")),
    ("docx", None, "openxmlformats-officedocument.wordprocessing", (".docx",)),
    ("xlsx", None, "spreadsheet", (".xlsx", ".xls")),
    ("txt", None, "text/plain", ()),
]


def sniff(content: Column, kind: Column, address: Column) -> Column:
    """The format of a file by ``FORMATS``: its first bytes, its content type or how its address ends; else ``unknown``."""
    head = F.decode(F.substring(content, 1, 5), "ISO-8859-1")
    low, where = (F.lower(F.coalesce(x, F.lit(""))) for x in (kind, address))
    out = F.lit("unknown")
    for name, magic, typed, ends in reversed(FORMATS):
        fits = F.contains(low, F.lit(typed))
        for e in ends:
            fits = fits | F.endswith(where, F.lit(e))
        out = F.when(fits | (head == magic), name).otherwise(out) if magic else F.when(fits, name).otherwise(out)
    return out


#: Fixed values of the register's guard: tiers, patterns of ids, digests and dates, what a core record must have.
TIERS, DOC_ID, SHA, DATE = ["core", "referenced", "method"], r"^[A-Z]{2,4}-[A-Z0-9]{2,12}-[A-Z0-9]{2,20}-[0-9]{4}$", r"^[a-f0-9]{64}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CORE_FIELDS = ["url", "sha256", "local_path", "url_accessed"]


def guard(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``doc_id, error`` for everything that keeps a register (text columns) from being published.

    Per record: a line break in any column, an id of another form, an unknown tier, a core record that lacks one of
    ``CORE_FIELDS``, a digest or date of another form, a sentence twice in the notes, another record without an address.
    For the whole (null ``doc_id``): repeated ids, and another number of records than ``rows``. Missing and empty are alike.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    said = F.filter(F.transform(F.split(F.coalesce("notes", F.lit("")), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    found = [F.when(F.contains(F.col(c), F.lit("\n")), F.lit(f"line break in {c}")) for c in df.columns]
    found += [F.when(~F.coalesce(F.col("doc_id").rlike(DOC_ID), F.lit(False)), "bad doc_id"), F.when(~F.coalesce(F.col("tier").isin(TIERS), F.lit(False)), "unknown tier")]
    found += [F.when((F.col("tier") == "core") & ~filled(c), F.lit(f"core record without {c}")) for c in CORE_FIELDS]
    found += [F.when(filled("sha256") & ~F.col("sha256").rlike(SHA), "malformed sha256"), F.when(filled("url_accessed") & ~F.col("url_accessed").rlike(DATE), "bad date")]
    found += [F.when(F.size(F.array_distinct(said)) < F.size(said), "sentence twice in notes"), F.when(F.col("tier").isin("referenced", "method") & ~filled("url"), "record without url")]
    each = df.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("error"))
    whole = df.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("doc_id") < F.count("doc_id")).alias("twice"))
    wrong = [F.when(F.col("twice"), "duplicate doc_id")]
    if rows is not None:
        wrong.append(F.when(F.col("n") != rows, F.concat(F.lit("row count "), "n", F.lit(f" is not {rows}"))))
    return each.unionByName(whole.select(F.lit(None).cast(dict(df.dtypes)["doc_id"]).alias("doc_id"), F.explode(F.array_compact(F.array(*wrong))).alias("error")))


def readiness(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, ``ready, missing``: whether each of the named tables has a row, and the names of those that have none."""
    some = [t.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), F.lit(name).alias("name"), "n") for i, (name, t) in enumerate(tables.items())]
    empty = F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.struct("i", "name"))))  # a row for each table
    return union_all(some).agg(empty.alias("e")).select((F.size("e") == 0).alias("ready"), F.array_join(F.transform("e", lambda x: x["name"]), ", ").alias("missing"))


def tallies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n`` for each of ``columns``; arrays count each element. One pass: rows are unpivoted, then counted."""
    kinds = dict(df.dtypes)
    pairs = [F.transform(F.col(c) if kinds[c].startswith("array") else F.array(c), _pair(c)) for c in columns]
    each = df.select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<field:string,value:string>>")) for p in pairs]))).alias("p"))
    return each.groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def _pair(name: str):
    return lambda x: F.struct(F.lit(name).alias("field"), x.cast("string").alias("value"))


def repeated_sentences(c: Column | str) -> Column:
    """Whether a text has a sentence twice (compared collapsed and regardless of case); false for null."""
    each = F.transform(F.split(F.col(c) if isinstance(c, str) else c, r"[.!?]\s+"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[.!?\s]+", " "))))
    full = F.filter(each, lambda x: x != "")
    return F.coalesce(F.size(F.array_distinct(full)) < F.size(full), F.lit(False))
