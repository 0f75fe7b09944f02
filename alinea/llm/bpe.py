"""A public byte-level BPE vocabulary compiled into a lazily determinised finite-state transducer.

How the merges become an automaton. Merging a text by rank gives, for each of its prefixes, one last token, and a
sequence of tokens is what the merges give exactly if each pair of neighbours is (``Merges.adjacent``). So the last
token at a place is the one vocabulary entry ending there that may follow the last token at its own start. The future
can only begin a token at a place from which the bytes so far are the start of some vocabulary entry; where the chains
of all these places meet, everything before is settled. A state of the transducer is therefore (last settled token,
bytes behind it), a transition reads one byte and emits the tokens that it settles, and the end of a text emits the
chain of the last place. States and transitions are built when first met and kept, up to a bound.

The lookahead is bounded: no more bytes than the longest vocabulary entry stay unsettled behind a place that can begin
a token. Texts are split by the vocabulary's pattern first; the automaton starts anew at each part.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import regex

#: The split of texts before merging, as in the vocabulary's description. White space is spelt out, so
#: that it is Unicode's property and not the library's own class.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: States, whole parts with their tokens, and pairs of tokens that are kept before each table starts anew.
MAX_STATES, MAX_PARTS, MAX_PAIRS = 150_000, 200_000, 500_000
_NEVER = 1 << 60


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that JSON vocabularies use for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks. ``token`` maps bytes to id, ``bytes_of`` id to bytes."""

    def __init__(self, token: dict[bytes, int], ranked: Iterable[tuple[bytes, bytes]]):
        self.token = token
        self.bytes_of = {i: b for b, i in token.items()}
        self.size = {i: len(b) for b, i in token.items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(ranked):
            pair = (token[a], token[b])
            self.rank[pair] = r
            made.setdefault(token[a + b], (r, *pair))
        self.right = {t: self._spine(t, made, 2) for t in self.bytes_of}
        self.left = {t: self._spine(t, made, 1) for t in self.bytes_of}
        self.longest = max(map(len, token))
        self.starts = {b[:i] for b in token for i in range(1, len(b))}
        self._adjacent: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _spine(t: int, made: dict, side: int) -> list[tuple[int, int]]:
        """The symbols at one edge of ``t`` while it is merged, each with the rank of the merge that consumes it."""
        out, until = [], _NEVER
        while True:
            out.append((t, until))
            if t not in made:
                return out
            until, t = made[t][0], made[t][side]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together gives these two tokens again.

        It doesn't if a merge across the border has its turn while both edge symbols stand: before the left one is
        consumed, and before or together with the right one, since among equal ranks the leftmost goes first.
        """
        known = self._adjacent.get((a, b))
        if known is None:
            known = not any((r := self.rank.get((x, y), _NEVER)) < x_until and r <= y_until for x, x_until in self.right[a] for y, y_until in self.left[b] if (x, y) in self.rank)
            if len(self._adjacent) > MAX_PAIRS:
                self._adjacent.clear()
            self._adjacent[(a, b)] = known
        return known

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a JSON vocabulary with merges, or a rank file of base64 tokens (whose merges are recovered from the ranks)."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            of = _byte_of_char()
            raw = lambda s: bytes(of[c] for c in s)
            pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
            return cls({raw(s): i for s, i in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs])
        with open(path, "rb") as f:
            token = {base64.b64decode(b): int(i) for b, i in (line.split() for line in f if line.strip())}
        return cls(token, [p for b, i in sorted(token.items(), key=lambda x: x[1]) if len(b) > 1 and (p := _last_merge(b, token))])


def _last_merge(word: bytes, token: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that are merged last into ``word`` when only ranks below its own count."""
    parts, below = [word[i : i + 1] for i in range(len(word))], token[word]
    while len(parts) > 2:
        best, at = min((token.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1])


_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern with Unicode properties.

    The standard library's engine is several times faster but has no properties, so each one is written out as the ranges
    of its characters, which the full engine names, up to U+FFFF; texts with characters beyond go to the full engine.
    """
    full = regex.compile(pattern).findall
    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))

    def ranges(name: str) -> str:
        runs = (m[0] for m in regex.finditer(rf"\p{{{name}}}+", plane))
        return "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in runs)

    def written(m) -> str:
        if m["set"]:  # a set with properties in it
            return regex.sub(r"\\p\{(\w+)\}", lambda x: ranges(x[1]), m["set"])
        return f"[{'^' if m['sign'] == 'P' else ''}{ranges(m['name'])}]"

    plain = re.compile(regex.sub(r"(?P<set>\[[^\]]*\])|\\(?P<sign>[pP])\{(?P<name>\w+)\}", written, pattern)).findall
    return lambda text: full(text) if _ASTRAL(text) else plain(text)


class _State:
    """Last settled token, bytes behind it, and the last token at each place among these bytes."""

    __slots__ = ("settled", "bytes", "last", "next", "end")

    def __init__(self, settled: int, pending: bytes, last: tuple[int, ...]):
        self.settled, self.bytes, self.last = settled, pending, last
        self.next: dict[int, tuple[tuple[int, ...], _State]] = {}
        self.end: tuple[int, ...] | None = None


class _Counts(dict):
    """How many ids a part has; made when first asked for, up to a bound."""

    def __init__(self, part: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.part = part

    def __missing__(self, text: str) -> int:
        n = len(self.part(text))
        if len(text) <= 64:
            if len(self) >= MAX_PARTS:
                self.clear()
            self[text] = n
        return n


class Transducer:
    """Bytes in, token ids out. ``encode`` splits a text first; ``feed`` and ``finish`` work on a stream of one part."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.split = merges, splitter(pattern)
        self._parts: dict[str, tuple[int, ...]] = {}
        self.known = self._parts.get  # the ids of a part met before, or none
        self._counts = _Counts(self.part)
        self._reset()

    def _reset(self) -> None:
        self.start = _State(-1, b"", ())
        self._states = {(-1, b""): self.start}

    def _chain(self, s: _State, place: int) -> list[int]:
        """Tokens that cover the first ``place`` pending bytes."""
        out, size = [], self.merges.size
        while place:
            t = s.last[place - 1]
            out.append(t)
            place -= size[t]
        return out[::-1]

    def _step(self, s: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        m = self.merges
        b = s.bytes + bytes((byte,))
        n = len(b)
        for i in range(max(0, n - m.longest), n):
            t = m.token.get(b[i:])
            if t is not None:
                before = s.last[i - 1] if i else s.settled
                if before < 0 or m.adjacent(before, t):
                    break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        grown = _State(s.settled, b, (*s.last, t))
        # Places from which a token may still begin, and the last place that the chains of all of them share.
        live = [j for j in range(max(0, n - m.longest), n) if b[j:] in m.starts] + [n]
        chains = [set(self._places(grown, j)) for j in live]
        cut = max(set.intersection(*chains))
        if not cut:
            return (), self._intern(grown)
        out = self._chain(grown, cut)
        rest = b[cut:]
        return tuple(out), self._intern(_State(out[-1], rest, grown.last[cut:]))

    def _places(self, s: _State, place: int) -> list[int]:
        out, size = [place], self.merges.size
        while place:
            place -= size[s.last[place - 1]]
            out.append(place)
        return out

    def _intern(self, s: _State) -> _State:
        return self._states.setdefault((s.settled, s.bytes), s)

    def feed(self, state: _State, data: bytes, out: list[int]) -> _State:
        """Read ``data``, append the tokens that it settles to ``out``, return the state reached."""
        for byte in data:
            step = state.next.get(byte)
            if step is None:
                step = state.next[byte] = self._step(state, byte)
            if step[0]:
                out += step[0]
            state = step[1]
        return state

    def finish(self, state: _State, out: list[int]) -> None:
        """Append the tokens of the bytes that are still pending when a part ends."""
        if state.end is None:
            state.end = tuple(self._chain(state, len(state.bytes)))
        out += state.end

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of one part. Whole parts are transitions as well: kept, as the words of a corpus repeat."""
        ids = self._parts.get(text)
        if ids is None:
            out: list[int] = []
            self.finish(self.feed(self.start, text.encode("utf-8", "replace"), out), out)
            ids = tuple(out)
            if len(text) <= 64:
                if len(self._parts) >= MAX_PARTS:
                    self._parts.clear()
                self._parts[text] = ids
            if len(self._states) > MAX_STATES:
                self._reset()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; an empty list for an empty or null text."""
        out: list[int] = []
        if text:
            known, part = self.known, self.part
            for p in self.split(text):
                out += known(p) or part(p)
        return out

    def count(self, text: str | None) -> int:
        """How many ids ``encode`` gives."""
        return sum(map(self._counts.__getitem__, self.split(text))) if text else 0


#: Unicode's table of well-formed UTF-8: first byte, range of the second, number of bytes after the first.
_LEADS = [
    (range(0x00, 0x80), None, 0),
    (range(0xC2, 0xE0), range(0x80, 0xC0), 1),
    (range(0xE0, 0xE1), range(0xA0, 0xC0), 2),
    (range(0xE1, 0xED), range(0x80, 0xC0), 2),
    (range(0xED, 0xEE), range(0x80, 0xA0), 2),
    (range(0xEE, 0xF0), range(0x80, 0xC0), 2),
    (range(0xF0, 0xF1), range(0x90, 0xC0), 3),
    (range(0xF1, 0xF4), range(0x80, 0xC0), 3),
    (range(0xF4, 0xF5), range(0x80, 0x90), 3),
]
_LEAD = {b: (second, n) for lead, second, n in _LEADS for b in lead}


class Utf8Machine:
    """Incremental UTF-8: bytes in, whole characters out. Ill-formed bytes come out as U+FFFD, one for each maximal part."""

    def __init__(self):
        self.held, self.need, self.second = b"", 0, None

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if b in (self.second or range(0x80, 0xC0)):
                    self.held, self.need, self.second = self.held + bytes((b,)), self.need - 1, None
                    if not self.need:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                out.append("�")
                self.held, self.need = b"", 0
            second, n = _LEAD.get(b, (None, -1))
            if n == 0:
                out.append(chr(b))
            elif n < 0:
                out.append("�")
            else:
                self.held, self.need, self.second = bytes((b,)), n, second
        return "".join(out)

    def finish(self) -> str:
        rest, self.held, self.need = ("�" if self.held else ""), b"", 0
        return rest


def decode_stream(merges: Merges, ids: Iterable[int]) -> Iterator[str]:
    """Text of a stream of ids, in pieces of whole characters however the tokens cut them."""
    machine = Utf8Machine()
    for i in ids:
        if piece := machine.feed(merges.bytes_of[i]):
            yield piece
    if piece := machine.finish():
        yield piece


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where the vocabulary file is: in ``folder``, else in the installed package of public tokenizers, else /opt/tokenizers."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, compiled once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(Merges.load(path))
    return _LOADED[path]
