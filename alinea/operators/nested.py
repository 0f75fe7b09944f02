"""Deeply nested records as flat tables with Merkle identities.

``shred`` turns each document into one row per occurrence of an object or array, the bridge table:

``src_table, line_no, occ_no`` (in document order), ``parent_occ`` (null at a root), ``step`` (field name, or empty in an
array), ``ordinal`` (place from 1; of a root, that among the payload's JSON values), ``node_hash``, ``kind`` (object,
array) and, where the occurrence plays a part in the judgments, ``role`` (record, judgment, round), ``record_no,
finding_no, round_no, clause_id`` and ``value_hash`` (the object that carries the judgment's or the ruling's values).

A node's hash is that of its canonical form: fields in order of name, scalars as JSON with numbers as written, inner
objects and arrays as ``{"#": hash}``, so equal subtrees have equal hashes wherever they stand. ``merkle_objects`` keeps
each once. No scalar is written as an object, except for numbers that JSON doesn't know (``{"=": "NaN"}``).

Every JSON object or array of a payload is read, whatever stands before, between and behind them and however deep it is.
JSON that the text's end cuts off gives no rows, nor do its complete parts. JSON that breaks off elsewhere gives those of
its parts that hold a whole record. JSON inside a string is opened where it is a list of findings, rounds or a ruling.
What could not be read comes out as a row of kind ``unread`` with the reason in ``step``: null, empty, no JSON, cut off,
broken (this only if the payload gave nothing at all).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alinea.plans.skew import skew_join

OCCURRENCE = "src_table string, line_no bigint, occ_no int, parent_occ int, step string, ordinal int, node_hash string, kind string, role string, record_no int, finding_no int, round_no int, clause_id string, value_hash string"
#: Fields of a judgment or ruling whose values are stored beside the object's identity.
FIELDS = ("control_id", "relationship")
#: Rows of an output batch, and identities that a task remembers as emitted (beyond them forms come out again).
BATCH, SEEN = 20_000, 1_000_000


class Number(str):
    """A number as it is written, so that neither digits nor size are lost."""


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=Number)
_BLANK = re.compile(r"[ \t\n\r]*")
#: Where JSON may begin: a bracket and what may stand behind it.
_OPEN = re.compile(r'\{(?=[ \t\n\r]*(?:["}]|\Z))|\[(?=[ \t\n\r]*(?:[\[{"\-0-9tfnNI\]]|\Z))')
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|NaN|-?Infinity)|(true|false|null)")
#: The rest of a text that ends inside a number or a word.
_STUMP = re.compile(r"(?:-|\.|[eE][-+]?|t|tr|tru|f|fa|fal|fals|n|nu|nul|N|Na|-?I[nfity]*)?\s*")
_WORDS = {"true": True, "false": False, "null": None}
_SPELT = {v: k for k, v in _WORDS.items()}
_quoted = json.encoder.encode_basestring


def _string(text: str, at: int) -> tuple[str | None, int, bool]:
    """The string whose quote stands at ``at`` and where it ends, or None, where it breaks, and whether the text ends there."""
    try:
        return *json.decoder.scanstring(text, at + 1, True), False
    except json.JSONDecodeError as e:
        return None, e.pos, e.msg.startswith("Unterminated") or e.msg.startswith("Invalid \\") and len(text) - e.pos <= 6 and "\\" not in text[e.pos + 2 :] and '"' not in text[e.pos :]


def _step_by_step(text: str, at: int):
    """The JSON that begins at ``at`` and its end, read without recursion; or, if it breaks, ``None``, the place, and whether the text's end cuts it off."""
    stack: list[tuple[dict | list, str]] = []
    i = at
    while True:
        i = _BLANK.match(text, i).end()
        c = text[i : i + 1]
        key, value, whole = "", None, True
        if c in ("{", "["):
            value, i = ({} if c == "{" else []), _BLANK.match(text, i + 1).end()
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                i += 1
            else:
                stack.append((value, ""))
                whole = False
        elif c == '"':
            value, i, cut = _string(text, i)
            if value is None:
                return None, i, cut
        elif m := _SCALAR.match(text, i):
            value, i = Number(m[1]) if m[1] else _WORDS[m[2]], m.end()
        else:
            return None, i, bool(_STUMP.fullmatch(text, i))
        while whole:  # put the value into its holder; a holder that ends is the next value
            if not stack:
                return value, i, False
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            i = _BLANK.match(text, i).end()
            c = text[i : i + 1]
            if c == ("}" if isinstance(holder, dict) else "]"):
                value, i = stack.pop()[0], i + 1
            elif c == ",":
                i, whole = i + 1, False
            else:
                return None, i, bool(_STUMP.fullmatch(text, i))
        if isinstance(stack[-1][0], dict):
            i = _BLANK.match(text, i).end()
            if text[i : i + 1] != '"':
                return None, i, i == len(text)
            key, i, cut = _string(text, i)
            if key is None:
                return None, i, cut
            i = _BLANK.match(text, i).end()
            if text[i : i + 1] != ":":
                return None, i, i == len(text)
            stack[-1] = (stack[-1][0], key)
            i += 1


def json_values(text: str | None) -> tuple[list, str]:
    """Every JSON object or array in ``text``, in order, and why something couldn't be read (empty if nothing is amiss).

    Where a bracket opens no JSON (as in prose), the search goes on behind it. A value inside JSON that breaks counts if
    it holds a record; inside JSON that the text's end cuts off, none does.
    """
    if text is None:
        return [], "null"
    if not text.strip():
        return [], "empty"
    out: list = []
    at, amiss, doubtful = 0, "", 0
    while m := _OPEN.search(text, at):
        i = m.start()
        try:
            value, end = _DECODER.raw_decode(text, i)
        except (json.JSONDecodeError, RecursionError):
            value, end, cut = _step_by_step(text, i)
            if value is None:
                if cut:
                    return out, "cut off"
                amiss, doubtful, at = "broken", max(doubtful, end), i + 1
                continue
        if i >= doubtful or any(True for _ in _records(value)):
            out.append(value)
            at = end
        else:
            at = i + 1
    return out, "" if out else amiss or "no JSON"


def _opened(value):
    """``value``, or the JSON that it spells if it is a string of JSON."""
    if type(value) is str and value.lstrip()[:1] in ("{", "["):
        found, amiss = json_values(value)
        return found[0] if found and not amiss else None
    return value


def _text(value) -> str:
    """A scalar as stored; an empty string for null, an inner object or array."""
    if value is None or isinstance(value, (dict, list)):
        return ""
    return value if isinstance(value, str) else json.dumps(value)


def _records(root) -> Iterator[tuple[int, dict]]:
    """Objects that carry a clause_id for their findings, with their place in the innermost list around them."""
    todo = [(1, root)]
    while todo:
        place, node = todo.pop()
        if isinstance(node, list):
            todo += [(i, x) for i, x in enumerate(node, 1) if isinstance(x, (dict, list))][::-1]
        elif isinstance(node, dict):
            if "clause_id" in node or isinstance(node.get("clause"), dict) and "clause_id" in node["clause"]:
                yield place, node
            else:
                todo += [(place, x) for x in node.values() if isinstance(x, (dict, list))][::-1]


def _inner(record: dict, name: str):
    """The value of the nearest field ``name`` in ``record`` or the objects in it; lists are not entered."""
    level = [record]
    while level:
        for node in level:
            if name in node:
                return node[name]
        level = [x for node in level for x in node.values() if isinstance(x, dict)]
    return None


def _listed(value) -> list:
    value = _opened(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


class _Document:
    """One document's occurrences. ``seen`` holds hashes whose object this task has emitted already."""

    def __init__(self, roots: list, seen: set[str], fields: Sequence[str], canonical: bool):
        self.rows, self.roles, self.hash_of = [], {}, {}
        self.fields, self.canonical = fields, canonical
        self.occurred, before = 0, 0
        for ordinal, root in enumerate(roots, 1):
            before = self._mark(root, before)
            self._walk(root, ordinal, seen)

    def _open(self, holder, name):
        """Open JSON inside a string in place, so that it is walked as part of the document."""
        value = holder.get(name)
        inner = _opened(value)
        if inner is not value and inner is not None:
            holder[name] = inner
        return inner

    def _mark(self, root, before: int) -> int:
        """Give roles; records of a payload's further values are counted on. Returns the last record's number."""
        last = before
        for place, record in _records(root):
            record_no = before + place
            last = max(last, record_no)
            clause_id = _text(record["clause_id"] if "clause_id" in record else record["clause"].get("clause_id"))
            self.roles[id(record)] = ("record", record_no, None, None, clause_id, record)
            holder = record
            while holder is not None and "findings" not in holder:
                holder = next((x for x in self._below(holder) if _inner(x, "findings") is not None), None)
            if holder is None:
                continue
            for finding_no, finding in enumerate(_listed(self._open(holder, "findings")), 1):
                if not isinstance(finding, dict):
                    continue
                self.roles[id(finding)] = ("judgment", record_no, finding_no, 0, clause_id, finding)
                self._open(finding, "debate")
                holders = [x for x in (finding.get("debate"), finding) if isinstance(x, dict) and x.get("rounds") is not None]
                rounds = _listed(self._open(holders[0], "rounds")) if holders else _listed(finding["debate"]) if isinstance(finding.get("debate"), list) else []
                for round_no, each in enumerate(rounds, 1):
                    if isinstance(each, dict):
                        ruling = self._open(each, "ruling")
                        self.roles[id(each)] = ("round", record_no, finding_no, round_no, clause_id, ruling if isinstance(ruling, dict) else None)
        return last

    @staticmethod
    def _below(node: dict) -> list[dict]:
        return [x for x in node.values() if isinstance(x, dict)]

    def _walk(self, root, ordinal: int, seen: set[str]) -> None:
        first, order, todo = self.occurred, [], [(root, None, "", ordinal)]
        while todo:
            node, parent, step, place = todo.pop()
            occ = first + len(order)
            order.append((node, parent, step, place))
            inner = node.items() if isinstance(node, dict) else [("", x) for x in node]
            todo += [(x, occ, k, i) for i, (k, x) in enumerate(inner, 1) if isinstance(x, (dict, list))][::-1]
        self.occurred += len(order)
        forms = {}
        for node, *_ in reversed(order):  # children come after their parent in document order
            if isinstance(node, dict):
                form = "{" + ",".join([f"{_quoted(k)}:{self._form(node[k])}" for k in sorted(node)]) + "}"
            else:
                form = "[" + ",".join(map(self._form, node)) + "]"
            self.hash_of[id(node)] = h = blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            if self.canonical:
                forms[h] = form
        none = (None,) * len(self.fields)
        for occ, (node, parent, step, place) in enumerate(order, first):
            h = self.hash_of[id(node)]
            role, record_no, finding_no, round_no, clause_id, values = self.roles.get(id(node), (None,) * 6)
            new, is_object = h not in seen, isinstance(node, dict)
            seen.add(h)
            kept = tuple([_text(node[f]) if f in node else None for f in self.fields]) if new and is_object else none
            self.rows.append((occ, parent, step, place, h, "object" if is_object else "array", role, record_no, finding_no, round_no, clause_id, self.hash_of[id(values)] if values is not None else None, *kept, forms[h] if new and self.canonical else None))

    def _form(self, value) -> str:
        if type(value) is str:
            return _quoted(value)
        if isinstance(value, (dict, list)):
            return f'{{"#":"{self.hash_of[id(value)]}"}}'
        if type(value) is Number:
            return f'{{"=":"{value}"}}' if value[-1] in "Ny" else value
        return _SPELT[value]


def _clean(s):
    return s.encode("utf-8", "replace").decode() if isinstance(s, str) and not s.isascii() else s


def _shredded(batches: Iterator[pa.RecordBatch], fields: Sequence[str], canonical: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    rows: list[tuple] = []

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        try:
            return pa.array(values, kind)
        except UnicodeEncodeError:  # half of a surrogate pair in some text
            return pa.array(map(_clean, values), kind)

    def made() -> pa.RecordBatch:
        return pa.record_batch([column(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    unread = (None,) * (len(schema) - 8)
    for batch in batches:
        for src, line, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            roots, amiss = json_values(payload)
            if roots:
                rows += [(src, line, *r) for r in _Document(roots, seen, fields, canonical).rows]
            if amiss:
                rows.append((src, line, None, None, amiss, None, None, "unread", *unread))
            if len(rows) >= BATCH:
                yield made()
                rows.clear()
            if len(seen) > SEEN:  # objects may then come out again; merkle_objects keeps one
                seen.clear()
    if rows:
        yield made()


def shred(documents: DataFrame, fields: Sequence[str] = FIELDS, canonical: bool = True) -> DataFrame:
    """One row per occurrence of an object or array in ``src_table, line_no, payload`` (JSON text). Other columns are dropped.

    ``fields`` (values of the object's own fields, empty for null and for inner objects) and, if asked for, ``canonical``
    are filled at least once for each hash and otherwise null, so repeated objects cost their hash only.
    """
    spec = ", ".join([OCCURRENCE, *[f"`{f}` string" for f in fields], "canonical string"])
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n.strip("`"), types[t]) for n, t in (x.split() for x in spec.split(", "))])
    run = partial(_shredded, fields=tuple(fields), canonical=canonical, schema=schema)
    return documents.select("src_table", F.col("line_no").cast("bigint"), F.col("payload").cast("string")).mapInArrow(run, spec)


def merkle_objects(occurrences: DataFrame) -> DataFrame:
    """Distinct nodes: ``node_hash, kind, canonical, n_occurrences``, combined map-side before the shuffle."""
    nodes = occurrences.where("kind <> 'unread'")
    return nodes.groupBy("node_hash").agg(F.first("kind").alias("kind"), F.max("canonical").alias("canonical"), F.count(F.lit(1)).alias("n_occurrences"))


def bridge(occurrences: DataFrame) -> DataFrame:
    """The parent-child rows alone, without the objects' contents: with ``merkle_objects`` they give back every document."""
    return occurrences.where("kind <> 'unread'").select(*[c.split()[0] for c in OCCURRENCE.split(", ")])


def unread(occurrences: DataFrame) -> DataFrame:
    """``src_table, line_no, reason`` of payloads that could not be read, or not to their end."""
    return occurrences.where("kind = 'unread'").select("src_table", "line_no", F.col("step").alias("reason"))


def flatten_judgments(occurrences: DataFrame, hot_rows: int = 250_000) -> DataFrame:
    """Judgments (``round_no`` 0) and rounds with the ``control_id`` and ``relationship`` of the object that carries them.

    Values are read from the distinct objects through the bridge rows; a hash that a large share of rows points to is
    salted. Absent and null values are empty strings, as are those of a round without a ruling.
    """
    # Only the two values of each distinct object that has them are shuffled, not the objects.
    read = occurrences.select("node_hash", *FIELDS).where("control_id is not null or relationship is not null")
    values = read.groupBy(F.col("node_hash").alias("value_hash")).agg(*[F.first(c).alias(c) for c in FIELDS])
    rows = occurrences.where(F.col("role").isin("judgment", "round")).select("src_table", "line_no", "record_no", "finding_no", "round_no", "clause_id", "value_hash")
    out = skew_join(rows, values, ["value_hash"], "left", None, hot_rows)
    return out.select("src_table", "line_no", "record_no", "finding_no", "round_no", "clause_id", *[F.coalesce(c, F.lit("")).alias(c) for c in FIELDS])
