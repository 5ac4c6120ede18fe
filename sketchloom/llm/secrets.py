"""Secret scan: fixed patterns and an assignment-aware lexer.

The lexer cuts source and configuration text into tokens: strings in quotes of
all kinds, with escapes, raw ones and ones over several lines, names, numbers
and bare values, references, elements of markup, and signs. Comments are read as
what surrounds them is, since a secret that is commented out is as much given
away. A parser reads pairs of a name and an expression from the tokens:

- ``name = expr``, ``name: expr``, ``name => expr``, ``name := expr``, also with
  quoted names, in brackets (``env["NAME"] = expr``), or with a type between
  (``NAME: &str = expr``); ``export``, ``const`` and the like don't matter;
- an expression is a sum of strings, bare values, names and calls, by ``+``,
  ``.``, ``..``, ``&``, ``||``, or by standing side by side as strings, in
  brackets over several lines or not; what a call or brackets hold counts as
  parts of it;
- ``export NAME=${BASE}rest``: bare values are put together from references and
  what stands between them;
- ``<name>value</name>`` and ``<tag name="value">``.

Literals are bound to their names, names that occur in later expressions stand
for what they were bound to (constants propagate), and every literal that
reaches a target is scored: the sensitivity of the target's name times the
strength of the whole value. Sensitive words are whole parts of a name, as cut at
signs, digits and changes of case. Literals of at least ``THRESHOLD`` become
spans of kind ``literal``, without their quotes.

Scale: one pass, no shuffle, a text at a time, and time that grows with a text
as its length does: each character is in one token, each token is read by one
pair, and a bound value is kept as counts of its characters and references to
what it was put together from, never as a copy. Spans are code points, end
exclusive.

Defined cases: null and empty texts have no spans; texts of any length are read
whole; a quote that isn't closed on its line, or a triple one or a bracket that
isn't closed at all, is a sign like others; a value of any length and of any
number of literals is bound, and a name stands for its latest value; repeated
rows give equal results each; equal spans of a kind count once; further columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sketchloom.llm.textkit import chunks, pick

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: As runs of any length of which those under 16 are dropped: runs are maximal either way.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
_WORDS = ("passw", "secret", "token", "api")

#: Kinds of tokens. A string's quotes and prefix are no part of its value.
_TOKEN = re.compile(
    r"""
    (?P<triple>[rRbBuUfF]{0,2}(?P<q3>\"{3}|'{3})(?P<t>(?:[^\\"']++|\\.|(?!(?P=q3)).)*+)(?P=q3))
  | (?P<rawhash>\b[rb]{1,2}\#")
  | (?P<double>(?:\b[rRbBuUfFL@]{1,2})?"(?P<d>(?:[^"\\\n]++|\\.)*+)")
  | (?P<single>(?:\b[rRbBuUfFL]{1,2})?'(?P<s>(?:[^'\\\n]++|\\.)*+)')
  | (?P<back>`(?P<b>(?:[^`\\]++|\\.)*+)`)
  | (?P<close></[A-Za-z_][\w.:-]*\s*>)
  | (?P<open><[A-Za-z_][\w.:-]*(?=[\s>/]))
  | (?P<reference>\$\{(?P<r1>[A-Za-z_][\w.-]*)\} | \$(?P<r2>[A-Za-z_]\w*) | \{\{\s*(?P<r3>[A-Za-z_][\w.-]*)\s*\}\} | %(?P<r4>[A-Za-z_]\w*)%)
  | (?P<word>(?:[^\s"'`=:;,()\[\]{}<>+&|$\#\\]++|\\.)++)
  | (?P<line>\n)
  | (?P<space>[^\S\n]++)
  | (?P<sign>:=|=>|->|==|!=|<=|>=|::|\.\.|\|\||&&|.)
    """,
    re.X | re.S,
)
_STRINGS = {"triple": "t", "double": "d", "single": "s", "back": "b"}
_PLAIN = ("rawhash", "close", "open", "word", "line", "space", "sign")
_NAME = re.compile(r"[.\-]?[A-Za-z_@][\w.\-]*\??!?")
_ASSIGNS = {"=", ":", ":=", "=>"}
_JOINS = {"+", "..", "&", "||"}
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: What follows a value on its line when the value is code: a bare word is then a name or a number, no value.
_CODE = ("(", "[")

#: Parts of names and how sure they make that a value is a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.8, "auth": 0.6, "signature": 0.5, "salt": 0.5}
THRESHOLD = 0.5
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@functools.lru_cache(1 << 14)
def sensitivity(name: str) -> float:
    """The largest weight of the parts of ``name``: runs of one, two or three of the words that it is cut into, in the singular."""
    words = [w.lower() for w in _PARTS.findall(name)]
    runs = {"".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return max((SENSITIVE.get(r, SENSITIVE.get(r.removesuffix("s"), 0.0)) for r in runs), default=0.0)


#: Character counts are scaled down beyond this, as values that double themselves again and again would grow without end.
_MANY = 1e12


class Value:
    """What a name is bound to: how often it has each character, whether one is white space, and where its literals are."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.blank = False
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Value] = []

    def literal(self, text: str, start: int) -> None:
        self.counts.update(text)
        self.blank |= any(c.isspace() for c in text)
        self.spans.append((start, start + len(text)))

    def constant(self, other: Value) -> None:
        self.counts.update(other.counts)
        self.blank |= other.blank
        self.parts.append(other)
        if (n := self.counts.total()) > _MANY:
            self.counts = Counter({c: k * _MANY / n for c, k in self.counts.items()})

    def strength(self) -> float:
        """0 to 1: by length and by the entropy of the characters."""
        n = self.counts.total()
        if n < 6 or self.blank:
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in self.counts.values() if k)
        return min(1.0, n / 16) * min(1.0, entropy / 3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns."""
    out = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(w.encode() in lower for w in _WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return out


class _Token:
    __slots__ = ("kind", "text", "start", "end", "line")

    def __init__(self, kind: str, text: str, start: int, end: int, line: int):
        self.kind, self.text, self.start, self.end, self.line = kind, text, start, end, line


def tokens(text: str) -> list[_Token]:
    """Strings (their value), references (the name), words, elements and signs, each with its place and its line; spaces are left out."""
    out, line, at = [], 0, 0
    closing = True  # whether there is an end of a raw string with a hash ahead
    while m := _TOKEN.match(text, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup in _PLAIN else next(k for k in (*_STRINGS, "reference") if m[k] is not None)
        if kind == "rawhash":
            end = text.find('"#', at) if closing else -1
            closing = end >= 0
            if closing:
                out.append(_Token("string", text[at:end], at, end, line))
                at = end + 2
            else:
                out.append(_Token("sign", m[0], m.start(), at, line))
        elif kind in _STRINGS:
            value = _STRINGS[kind]
            out.append(_Token("string", m[value], m.start(value), m.end(value), line))
        elif kind == "reference":
            out.append(_Token(kind, next(filter(None, m.group("r1", "r2", "r3", "r4"))), m.start(), at, line))
        elif kind not in ("space", "line"):
            out.append(_Token(kind, m[0], m.start(), at, line))
        if kind not in ("word", "space", "sign"):
            line += text.count("\n", m.start(), at)
    return out


class _Pairs:
    """The pairs of a text, one after the other."""

    def __init__(self, text: str):
        self.all, self.at, self.known = tokens(text), 0, {}
        self.all.append(_Token("end", "", len(text), len(text), -1))
        self.text = text

    def _assigned(self, i: int) -> int:
        """Where the expression begins if a name ends before token ``i``; else 0."""
        one, more = self.all[i], self.all[min(i + 1, len(self.all) - 1)]
        if one.kind != "sign" or one.line != self.all[i - 1].line:
            return 0
        if one.text == "=" and more.text == "=" or one.text not in _ASSIGNS:
            return 0
        if one.text == ":":
            # a type may stand between: what is up to an equals sign on this line, if it holds no string
            for j in range(i + 1, min(i + 12, len(self.all))):
                t = self.all[j]
                if t.line != one.line or t.kind in ("string", "end", "reference") or t.text in (",", ";", "{", ":", "=>"):
                    break
                if t.text == "=":
                    return j + 1 if self.all[j + 1].text != "=" else 0
        return i + 1

    def _part(self, value: Value, i: int, line: int, inside: bool) -> int:
        """Add the part of an expression that token ``i`` begins to ``value``; the place after it, or ``i`` if there is none."""
        t = self.all[i]
        if t.kind == "string":
            value.literal(t.text, t.start)
            return i + 1
        if t.kind == "reference" or t.kind == "word":
            # bare values are all that touches: words, references and the signs of such values
            j, pieces = i, []
            while (x := self.all[j]).kind in ("word", "reference") or j > i and x.kind == "sign" and x.text in ("=", "+", ":", "&", "$", "|") and not inside:
                if j > i and x.start != self.all[j - 1].end:
                    break
                pieces.append(x)
                j += 1
            while pieces and pieces[-1].kind == "sign" and pieces[-1].text != "=":
                pieces.pop()
                j -= 1
            if len(pieces) == 1:
                name = t.text.removeprefix("&").removeprefix("*")
                if name in self.known:
                    value.constant(self.known[name])
                elif t.kind == "word" and self.all[j].text in _CODE and self.all[j].start == t.end:
                    return self._brackets(value, j)  # a call or an element: what is in its brackets counts
                elif t.kind == "word":
                    value.literal(t.text, t.start)
                return j
            # runs of what stands between references
            start = None
            for x in [*pieces, None]:
                if x is not None and x.kind != "reference":
                    start = x.start if start is None else start
                    last = x.end
                    continue
                if start is not None:
                    value.literal(self.text[start:last], start)
                    start = None
                if x is not None and x.text in self.known:
                    value.constant(self.known[x.text])
            return j
        if t.kind == "sign" and t.text in ("(", "["):
            return self._brackets(value, i)
        return i

    def _brackets(self, value: Value, i: int) -> int:
        """Add what brackets hold, over lines, to ``value``; the place after them, or ``i`` if they aren't closed."""
        open_, j, mine = [self.all[i].text], i + 1, Value()
        while open_:
            t = self.all[j]
            if t.kind == "end" or len(open_) > 50:
                return i
            if t.kind == "sign" and t.text in ("(", "["):
                open_.append(t.text)
            elif t.kind == "sign" and t.text in (")", "]", "}"):
                if _CLOSES[open_.pop()] != t.text:
                    return i
            elif t.kind == "sign" and t.text in ("{", ";"):
                return i
            elif t.kind == "string":
                mine.literal(t.text, t.start)
            elif t.kind in ("word", "reference") and t.text in self.known:
                mine.constant(self.known[t.text])
            j += 1
        if mine.spans or mine.parts:
            value.constant(mine)
        return j

    def _expression(self, i: int) -> tuple[Value, int]:
        """The value that begins at token ``i``, and the place after it."""
        value, line = Value(), self.all[i - 1].line
        j = i
        while True:
            t = self.all[j]
            # what is on a later line only goes on after a sign that joins, or as a string after a string in brackets
            if t.line != line and not (j > i and self.all[j - 1].text in _JOINS):
                break
            k = self._part(value, j, line, False)
            if k == j:
                break
            line, j = self.all[k - 1].line, k
            if self.all[j].kind == "sign" and self.all[j].text in _JOINS and (self.all[j].line == line or self.all[j].text in ("+", "..")):
                line, j = self.all[j].line, j + 1
                continue
            if self.all[j].kind == "string" and self.all[j - 1].kind == "string" and self.all[j].line == line:
                continue  # strings side by side are one
            if self.all[j].kind == "word" and self.all[j].text.startswith(".") and self.all[j].start == self.all[j - 1].end:
                line, j = self.all[j].line, j + 1  # a method of the value
                if self.all[j].text in _CODE:
                    j = max(self._brackets(value, j), j)
                continue
            break
        return value, j

    def __iter__(self) -> Iterator[tuple[str, Value]]:
        i = 1
        opened: tuple[str, int] | None = None
        while i < len(self.all):
            t, before = self.all[i], self.all[i - 1]
            if t.kind == "close":
                # an element's text: what stands between its two tags, without elements of its own
                name = re.sub(r"[</>\s]", "", t.text)
                if opened and opened[0] == name:
                    inner = self.text[opened[1] : t.start]
                    bare = inner.strip()
                    if bare:
                        value = Value()
                        value.literal(bare, opened[1] + inner.index(bare))
                        yield name, value
                opened = None
                i += 1
                continue
            if before.kind == "open" or t.kind == "open" and i == 1:
                tag, j = before, i
                # up to the end of the tag, whose pairs are read as others are
                while self.all[j].kind != "end" and self.all[j].text != ">" and self.all[j].kind not in ("open", "close"):
                    j += 1
                opened = (tag.text[1:], self.all[j].end) if self.all[j].text == ">" and self.all[j - 1].text != "/" else None
            name = None
            if before.kind == "word" and _NAME.fullmatch(before.text):
                name = before.text.strip("?!").lstrip("-.")
            elif before.kind == "string" and 0 < len(before.text) <= 200 and _NAME.fullmatch(before.text):
                name = before.text
            elif before.text == "]" and i >= 4 and self.all[i - 2].kind == "string" and self.all[i - 3].text == "[":
                name = self.all[i - 2].text
            begin = self._assigned(i) if name else 0
            if not begin:
                i += 1
                continue
            value, after = self._expression(begin)
            if after > begin and (value.spans or value.parts):
                self.known[name] = value
                yield name, value
            # a word that ends one value may be the name of the next pair (a = b = value)
            nested = after > begin and self._assigned(after) if after < len(self.all) else 0
            i = after if nested else max(after, begin, i + 1)


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of each assignment, constants put in."""
    if "=" not in text and ":" not in text and "</" not in text:
        return iter(())
    return iter(_Pairs(text))


#: Without any of these no name is sensitive.
_STEMS = re.compile(r"pass|pwd|secret|token|key|credential|auth|signature|salt", re.I | re.A)


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Spans of the literals that reach sensitive names."""
    if not _STEMS.search(text):
        return []
    out: set[tuple[int, int, int]] = set()
    told: set[int] = set()  # values whose spans are in ``out``; ``kept`` holds them, so that no other gets their number
    kept = []
    for name, value in pairs(text):
        weight = sensitivity(name)
        if weight and weight * value.strength() >= threshold:
            kept.append(value)
            left = [value]
            while left:
                one = left.pop()
                if id(one) not in told:
                    told.add(id(one))
                    out.update((3, a, b) for a, b in one.spans if b > a)
                    left += one.parts
    return sorted(out)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _run(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found = sorted({*base_spans(text), *literal_spans(text, threshold)}, key=lambda x: (x[1], x[0], x[2]))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], ["doc_id", "found"])

    return run


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, found (kind, start, end), by start and then kind."""
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_run(threshold), "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")
