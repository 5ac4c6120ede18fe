"""License scan: Aho-Corasick for tags and notice phrases, shunting-yard for expressions.

One automaton holds the notice phrases, written as space-joined words with a
space at either end, and runs over the words of a text written alike. A second
one finds identifier tags in the lower-cased text; what follows a tag is read as
a licence expression (ids, AND, OR, WITH, parentheses), put into postfix order
by a shunting-yard parser and evaluated: each id has a freedom from 0 to 1, OR
takes the larger (the user may choose), AND the smaller, WITH moves the left
side half of its way to 1.

Scale: one pass, no shuffle, memory of one chunk of texts.

Defined cases: null and empty texts have no words, labels "" and score 0; texts
of any length are read whole; repeated rows give equal results each; phrases
that overlap all count; a broken expression is read as far as it is valid,
missing closing parentheses are added, and a tag without any id gives nothing;
further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sketchloom.llm.textkit import WORD_BYTES, chunks, pick, text_of

#: Phrases whose places are counted; they keep their labels whatever else is found.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "gnu free documentation license": "gfdl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "creative commons": "cc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "proprietary and confidential": "proprietary",
    "unauthorized copying": "proprietary",
    "no part of this publication may be reproduced": "reserved",
}
TAGS = ("spdx-license-identifier:", "spdx-licence-identifier:", "license-expression:", "licence-expression:", "license-id:", "packagelicensedeclared:", "packagelicenseconcluded:", "licenseinfoinfile:")
#: How freely works under a licence may be reused; ids are matched by their longest prefix here.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "0bsd": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc": 0.6, "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6,
    "bsl": 1.0, "artistic": 0.9, "psf": 1.0, "ofl": 0.9, "odbl": 0.6, "eupl": 0.5, "cddl": 0.6, "gfdl": 0.4, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "busl": 0.2, "sspl": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
UNKNOWN = 0.5

_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")


def tokens(text: str) -> list[str]:
    """The longest run of tokens of ``text`` that is the start of an expression."""
    out: list[str] = []
    depth, at, operand = 0, 0, True
    while m := _TOKEN.match(text, at):
        word = m[1]
        known = word.upper() in _RANK
        if operand and word == "(":
            depth += 1
        elif operand and word != ")" and not known:
            operand = False
        elif not operand and word == ")" and depth:
            depth -= 1
        elif not operand and known:
            operand = True
        else:
            break
        out.append(word.upper() if known else word)
        at = m.end()
    while out and (out[-1] in _RANK or out[-1] == "("):
        out.pop()
    return out


def postfix(parts: list[str]) -> list[str]:
    """Shunting-yard: operators after their operands; all of them bind to the left."""
    out, stack = [], []
    for part in parts:
        if part in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[part]:
                out.append(stack.pop())
            stack.append(part)
        elif part == "(":
            stack.append(part)
        elif part == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            out.append(part)
    return out + [x for x in reversed(stack) if x != "("]


def freedom(label: str) -> float:
    label = label.lower()
    best = max((k for k in FREEDOM if label == k or label.startswith(k + "-")), key=len, default=None)
    return UNKNOWN if best is None else FREEDOM[best]


@dataclass
class Expression:
    """A canonical text, the licence ids, and the freedom."""

    text: str
    ids: list[str]
    value: float


def evaluate(parts: list[str]) -> Expression | None:
    """The value of the tokens of an expression."""
    stack: list[tuple[str, int, list[str], float]] = []
    for part in postfix(parts):
        if part not in _RANK:
            stack.append((part.lower(), 4, [part.lower()], freedom(part)))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        rank = _RANK[part]
        shown = [x[0] if x[1] >= rank else f"({x[0]})" for x in (left, right)]
        if part == "WITH":
            stack.append((f"{shown[0]} with {shown[1]}", rank, left[2], (1 + left[3]) / 2))
        else:
            value = (max if part == "OR" else min)(left[3], right[3])
            stack.append((f"{shown[0]} {part.lower()} {shown[1]}", rank, left[2] + right[2], value))
    return Expression(stack[0][0], stack[0][2], stack[0][3]) if len(stack) == 1 else None


def automaton(patterns: dict) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in patterns.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


class Scanner:
    """Scans one text at a time; ``base`` and ``notices`` map phrases of words to labels."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS):
        phrases = {f" {p} ": (True, label, p.count(" ") + 1, len(p) + 2) for p, label in base.items()}
        self.notices = automaton({f" {p} ": (False, label, p.count(" ") + 1, len(p) + 2) for p, label in notices.items() if p not in base} | phrases)
        self.tags = automaton({t: len(t) for t in tags})

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, bool, int, int]], list[Expression]]:
        """Number of words; matches (label, base, first word, words); expressions."""
        words = text.translate(WORD_BYTES).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        found, seen, at = [], 0, 0
        for end, (base, label, n, size) in self.notices.iter(line):
            # words that end at or before this match: count the spaces from where the last count stopped
            seen += line.count(" ", at, end)
            at = end
            found.append((label, base, seen - n, n))
        lower = text.lower()
        shown = []
        if b":" in lower:
            for end, _ in self.tags.iter(lower.decode("latin-1")):
                stop = lower.find(b"\n", end)
                if got := evaluate(tokens(text[end + 1 : stop if stop >= 0 else None].decode("latin-1"))):
                    shown.append(got)
        return len(words), found, shown


def score(matches, expressions) -> float:
    """Freedom of reuse that the notices state: the least of all of them, 0 without any."""
    values = [freedom(label) for label, *_ in matches] + [e.value for e in expressions]
    return min(values) if values else 0.0


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("words", pa.int64())]))
_EXPRESSION = pa.list_(pa.struct([("text", pa.string()), ("ids", pa.list_(pa.string())), ("value", pa.float64())]))
_SCHEMA = "doc_id bigint, n_words bigint, matches array<struct<label:string,base:boolean,word:bigint,words:bigint>>, expressions array<struct<text:string,ids:array<string>,value:double>>, score double"


def _run(base, notices, tags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags)
        for batch in chunks(batches):
            got = [scanner.scan(text_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[dict(zip(("label", "base", "word", "words"), m)) for m in ms] for _, ms, _ in got], _MATCH),
                    pa.array([[{"text": e.text, "ids": e.ids, "value": e.value} for e in es] for _, _, es in got], _EXPRESSION),
                    pa.array([score(ms, es) for _, ms, es in got], pa.float64()),
                ],
                ["doc_id", "n_words", "matches", "expressions", "score"],
            )

    return run


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """Per row: doc_id, n_words, matches (label, base, first word, words), expressions, score."""
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_run(base, notices, tags), _SCHEMA)
