"""Problem 8: texts above a token limit cut into pieces within it, at the text's own pauses, with a set overlap.

A text's tokens are grouped into atomic segments that end at its pauses; neighbouring segments are then merged over the
weakest pause first (among equal ones the smallest result, then the earliest), as long as the merged segment and the
overlap in front of it fit. Pauses by strength: paragraph, line, sentence, semicolon or colon, comma, blank, the borders
between words and marks without a blank, any other token border. Segments begin at commas and above; only where such a
segment alone is too large are weaker pauses used inside it, so a piece ends inside a word only if there is no other way.

Every piece but the first begins with the last ``overlap`` tokens of the text before its own part (a few more where this
would fall inside a character). Pieces are stretches of the text itself, and never end inside a character.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate
from operator import sub
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from alinea.llm.bpe import Transducer, tokenizer_path, transducer
from alinea.plans.unions import union_all
from alinea.sources.tables import table

PAUSES = ["token", "inner", "blank", "comma", "colon", "sentence", "line", "paragraph", "end"]
TOKEN, INNER, BLANK, COMMA, COLON, SENTENCE, LINE, PARAGRAPH, END = range(9)
#: A character has at most four bytes, so an overlap grows by at most three tokens to begin with a whole one.
SLACK = 3
_STOPS, _COLONS, _COMMAS = set(".!?…。！？؟।"), set(";:；：؛"), set(",，、،")
_WIDE = set("。！？；：，、")
_CLOSERS = "\"'’”)]}»」』"
#: Limits that are read on the driver at most; more raise ValueError.
MAX_LIMITS = 1000
#: Parts that a task keeps what it found out of, before it starts anew.
MAX_MET = 200_000
#: Bytes of text in an output batch.
BATCH_BYTES = 8 << 20


class Limit(NamedTuple):
    name: str
    max_tokens: int
    overlap: int
    tokenizer: str = "byte_bpe_50k.json"


class Borders(NamedTuple):
    """For each token border 0..n of a text: the character offset (-1 inside a character) and the pause there."""

    char: list[int]
    pause: list[int]


def _pause(p: str, q: str, newlines: int) -> int:
    """The pause between the parts ``p`` and ``q``; ``newlines``: how many the white space up to here has."""
    if newlines and q.strip():
        return PARAGRAPH if newlines > 1 else LINE
    if q[0].isspace() or p[-1] in _WIDE or p[-1:] in _CLOSERS and p[-2:-1] in _WIDE:
        end = p.rstrip(_CLOSERS)[-1:] or p[-1]
        return SENTENCE if end in _STOPS else COLON if end in _COLONS else COMMA if end in _COMMAS else BLANK
    return BLANK if p[-1].isspace() else INNER


class _Part(NamedTuple):
    """What borders need of a part of a text, whatever stands around it."""

    tokens: int
    chars: int
    offsets: tuple[int, ...]  # of each token's end, -1 inside a character; empty for a single token
    blank: bool
    newlines: int
    spaced: bool  # begins with a blank
    word: bool  # ends like a word


def _part(p: str, ids: tuple[int, ...], size: list[int]) -> _Part:
    offsets: list[int] = []
    if len(ids) > 1:
        ends = list(accumulate(size[i] for i in ids))
        if p.isascii():
            offsets = ends
        else:
            place, n = {}, 0
            for k, c in enumerate(p, 1):
                n += len(c.encode("utf-8", "replace"))
                place[n] = k
            offsets = [place.get(e, -1) for e in ends]
    blank = p.isspace()
    return _Part(len(ids), len(p), tuple(offsets), blank, p.count("\n") if blank else 0, p[0] == " ", p[-1].isalnum())


class Parts(dict):
    """What was found out about the parts of texts so far, as the words of a corpus repeat; up to a bound."""

    def __init__(self, t: Transducer):
        super().__init__()
        self.t = t

    def __missing__(self, p: str) -> _Part:
        made = _part(p, self.t.part(p), self.t.merges.size)
        if len(p) <= 64:
            if len(self) >= MAX_MET:
                self.clear()
            self[p] = made
        return made


def borders(text: str, t: Transducer, more_than: int = -1, met: Parts | None = None) -> Borders | None:
    """Token borders of ``text`` with their pauses; null if it has no more tokens than ``more_than``."""
    parts = t.split(text)
    known = list(map((Parts(t) if met is None else met).__getitem__, parts))
    if sum([w[0] for w in known]) <= more_than:
        return None
    char, pause, at, newlines, before = [0], [END], 0, 0, ""
    after_blank = after_word = False
    for p, (n, chars, offsets, blank, breaks, spaced, word) in zip(parts, known):
        if after_word and not newlines and not blank:
            pause[-1] = BLANK if spaced else INNER
        elif before:
            pause[-1] = _pause(before[-8:], p, newlines)
        newlines = breaks + (newlines if after_blank else 0) if blank else 0
        if n == 1:
            char.append(at + chars)
            pause.append(TOKEN)
        else:
            char += [at + o if o >= 0 else -1 for o in offsets]
            pause += [TOKEN] * n
        at += chars
        before, after_blank, after_word = p, blank, word
    pause[-1] = END
    return Borders(char, pause)


def _atoms(b: Borders, room: int) -> list[int]:
    """Ends of the atomic segments: pauses from commas up, weaker ones where a segment is larger than ``room``."""
    n = len(b.char) - 1
    cuts = [0, *(i for i in range(1, n) if b.pause[i] >= COMMA and b.char[i] >= 0), n]
    for weaker in (BLANK, INNER, TOKEN):
        if max(map(sub, cuts[1:], cuts)) <= room:
            break
        finer = [0]
        for x, y in zip(cuts, cuts[1:]):
            if y - x > room:
                finer += [i for i in range(x + 1, y) if b.pause[i] >= weaker and b.char[i] >= 0]
            finer.append(y)
        cuts = finer
    return cuts


def _shared(b: Borders, at: int, overlap: int) -> int:
    """Where a piece whose own part begins at border ``at`` begins with its overlap."""
    start = max(0, at - overlap) if overlap else at
    while b.char[start] < 0:
        start -= 1
    return start


def cut(b: Borders, limit: Limit) -> list[int]:
    """Borders between the pieces' own parts, from 0 to the number of tokens."""
    most, overlap = limit.max_tokens, limit.overlap
    ends = _atoms(b, most - overlap - (SLACK if overlap else 0))
    lead = [0, *(_shared(b, i, overlap) for i in ends[1:-1])]  # where segment k begins with its overlap
    k = len(ends) - 1
    after, before, stop = list(range(1, k + 1)), list(range(-1, k - 1)), ends[1:]
    alive = [True] * k

    def entry(i: int):
        j = after[i]
        return (b.pause[ends[j]], stop[j] - ends[i], i, j, stop[j])

    pause = b.pause
    heap = [(pause[y], z - x, i, i + 1, z) for i, (x, y, z) in enumerate(zip(ends, ends[1:], ends[2:]))]
    heapq.heapify(heap)
    while heap:
        _, _, i, j, end = heapq.heappop(heap)
        if not (alive[i] and after[i] == j and j < k and alive[j] and stop[j] == end):
            continue  # one of the two has been merged since; a newer entry stands for it
        if end - lead[i] > most:
            continue  # segments only grow: these two never fit
        alive[j] = False
        stop[i], after[i] = end, after[j]
        if after[i] < k:
            before[after[i]] = i
            heapq.heappush(heap, entry(i))
        if before[i] >= 0:
            heapq.heappush(heap, entry(before[i]))
    parts = [ends[i] for i in range(k) if alive[i]] + [ends[-1]]
    while len(parts) > 2 and parts[1] < overlap:  # the next piece would hold all of the first one
        del parts[1]
    return parts


def _size(text: str, b: Borders, x: int, y: int, t: Transducer) -> int:
    """Tokens of the text between two borders, encoded on its own.

    Mostly the tokens between them: a stretch of a word's tokens is the encoding of its bytes, and the split of a text
    into words goes on alike from any border. An apostrophe cut from marks before it may begin a word, so then all is
    encoded anew; white space at the end no longer leaves its last character to what follows, so it is encoded anew.
    """
    a, z = b.char[x], b.char[y]
    if b.pause[x] == TOKEN and text[a] == "'":
        return len(t.encode(text[a:z]))
    end = len(text[a:z].rstrip()) + a
    if z - end < 2:
        return y - x
    k = y
    while k > x and not 0 <= b.char[k] <= end:
        k -= 1
    if k == x or b.char[k] != end:
        return len(t.encode(text[a:z]))
    return k - x + len(t.encode(text[end:z]))


def pieces(text: str, limit: Limit, t: Transducer, b: Borders) -> Iterator[tuple[int, int, int, int, int]]:
    """(first character, end, tokens of the piece's text, shared tokens, pause at the end) for each piece in order."""
    parts = cut(b, limit)
    todo = list(zip(parts, parts[1:]))[::-1]
    while todo:
        x, y = todo.pop()
        start = _shared(b, x, limit.overlap) if x else 0
        n = _size(text, b, start, y, t)
        inner = [i for i in range(x + 1, y) if b.char[i] >= 0] if n > limit.max_tokens else None
        if inner:  # cut from its surroundings, a stretch can take more tokens: it is halved at its strongest pause
            at = max(inner, key=lambda i: (b.pause[i], -abs(2 * i - x - y)))
            todo += [(at, y), (x, at)]
            continue
        yield b.char[start], b.char[y], n, x - start, b.pause[y]


SCHEMA = "limit_name string, {key} {kind}, piece_no int, start_char int, end_char int, n_tokens int, shared_tokens int, ends_at string, piece string"


def split_oversized(df: DataFrame, key: str, text: str, limits: list[Limit], folder: str | None = None) -> DataFrame:
    """One row for each piece of each text that has more tokens than a limit: ``SCHEMA``.

    ``piece`` is ``text[start_char:end_char]`` and has ``n_tokens`` tokens, at most ``max_tokens``; ``shared_tokens`` of
    the text's own tokens it shares with the piece before it. Texts within a limit, null and empty ones give no row for
    it. Repeated rows are cut each for itself. Texts are read whole. No shuffle. ``max_tokens`` must be larger than the
    overlap by 8 at least, and names must differ, or ValueError is raised. One pass for each tokenizer that limits name.
    """
    if len({x.name for x in limits}) < len(limits):
        raise ValueError("names of limits must differ")
    for x in limits:
        if x.max_tokens - x.overlap < 8 or x.overlap < 0:
            raise ValueError(f"{x}: max_tokens must exceed the overlap by 8 at least")
    by_tokenizer: dict[str, list[Limit]] = {}
    for x in limits:
        by_tokenizer.setdefault(x.tokenizer, []).append(x)
    each = [_split(df, key, text, mine, tokenizer_path(t, folder)) for t, mine in by_tokenizer.items()]
    return union_all(each) if each else _split(df.limit(0), key, text, [], "")


def _split(df: DataFrame, key: str, text: str, limits: list[Limit], path: str) -> DataFrame:
    schema = SCHEMA.format(key=f"`{key}`", kind=dict(df.dtypes)[key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        met = Parts(t)
        least = min((x.max_tokens for x in limits), default=0)
        rows: list[tuple] = []
        held, types = 0, None
        names = ["limit_name", key, "piece_no", "start_char", "end_char", "n_tokens", "shared_tokens", "ends_at", "piece"]

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)

        for batch in batches:
            i32, s = pa.int32(), pa.string()
            types = [s, batch.schema.field(0).type, i32, i32, i32, i32, i32, s, s]
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value or len(value.encode("utf-8", "replace")) <= least:  # a token has one byte at least
                    continue
                b = borders(value, t, least, met)
                for limit in limits if b else ():
                    if len(b.char) - 1 > limit.max_tokens:
                        for no, (x, y, n, shared, end) in enumerate(pieces(value, limit, t, b), 1):
                            rows.append((limit.name, name, no, x, y, n, shared, PAUSES[end], value[x:y]))
                            held += y - x
                        if held > BATCH_BYTES:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return df.select(key, text).mapInArrow(run, schema)


def read_limits(limits: DataFrame) -> list[Limit]:
    """The piece limits of a settings table, read on the driver. More than ``MAX_LIMITS`` raise ValueError.

    A null overlap is none, a null or empty tokenizer ``byte_bpe_50k``.
    """
    name = F.coalesce(F.nullif(F.trim("tokenizer"), F.lit("")), F.lit("byte_bpe_50k"))
    rows = limits.where(F.col("used_for") == "piece").select("limit_name", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).cast("int"), F.concat(name, F.lit(".json"))).limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    return [Limit(*r) for r in rows]


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents for every piece limit in size_limits."""
    limits = read_limits(table(spark, d, "size_limits"))
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", limits)


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any right cut: per limit, the texts cut and that their pieces go from end to end, in the limit, without a hole."""
    made = p8_pieces(spark, d).join(F.broadcast(table(spark, d, "size_limits").where("used_for = 'piece'").select("limit_name", "max_tokens")), "limit_name")  # a row for each limit
    own = F.col("end_char") - F.col("start_char")
    per = made.groupBy("limit_name", "doc_id").agg(
        F.min("start_char").alias("first"), F.max("end_char").alias("last"), F.max(F.col("n_tokens") - F.col("max_tokens")).alias("over"), F.count(F.lit(1)).alias("n"), F.max("piece_no").alias("no"), F.sum(own).alias("chars"), F.count_if(F.length("piece") != own).alias("off"))
    met = per.join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars")), "doc_id")
    good = (F.col("first") == 0) & (F.col("last") == F.col("n_chars")) & (F.col("over") <= 0) & (F.col("n") == F.col("no")) & (F.col("chars") >= F.col("n_chars")) & (F.col("off") == 0)
    return met.groupBy("limit_name").agg(F.bool_and(good).alias("good"))


def queries() -> dict:
    return {"p8_pieces": p8_pieces, "p8_whole": p8_whole}


def oracle_sql() -> dict[str, str]:
    return {"p8_whole": "SELECT limit_name, true AS good FROM size_limits WHERE used_for = 'piece'"}
