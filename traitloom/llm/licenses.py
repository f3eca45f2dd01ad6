"""License scan: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates the expressions.

One automaton over the normalised words of a text finds notice phrases, and
whether it holds an identifier tag at all; it runs in one pass whatever the number
of phrases.  In texts with a tag a second automaton over the bytes finds where
each tag ends.  The expression there, up to the line's end or the next tag, is
parsed into postfix form (WITH binds tightest, then AND, then OR).

Evaluation goes by terms (`TERMS`, least strict first): what AND joins holds
together, so its terms are the stricter ones and both sides' licences apply; of an
OR the less strict side is taken, or both sides where they are as strict; an
exception eases a copyleft licence by one step.  The licences that apply and the
terms of the whole are labels.  Parsing and evaluation take time in proportion to
the text.

Base phrases are reported with their places; further phrases and expressions
only add labels.

Defined cases: null text counts as empty; no match gives empty labels, null
places and score 0; repeated rows are reported once per row; of a tag's text the
longest well-formed expression at its start counts, and without one the tag adds
nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, chunks, doc_view

#: Base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases and their labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-notice",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by-notice",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: The tag before an expression, as bytes of a lower-cased text and as normalised words.
TAG, TAG_WORDS = "spdx-license-identifier:", "spdx license identifier"
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")
BINDS = {"OR": 1, "AND": 2, "WITH": 3}
#: Terms, least strict first.
TERMS = ("permissive", "weak-copyleft", "copyleft", "restricted")
#: Beginnings of licence identifiers by their terms; the longest that fits counts, and any other licence is restricted.
STRICT = {
    "permissive": ("0bsd", "afl", "apache", "artistic", "bsd", "bsl-1.0", "cc0", "cc-by", "ecl", "isc", "mit", "ncsa", "openssl", "php", "postgresql", "psf", "python", "unlicense", "upl", "w3c", "wtfpl", "x11", "zlib", "zpl"),
    "weak-copyleft": ("cddl", "cecill-c", "epl", "eupl", "lgpl", "mpl", "ms-rl", "osl"),
    "copyleft": ("agpl", "cc-by-sa", "cecill", "gfdl", "gpl", "sspl"),
    "restricted": ("cc-by-nc", "cc-by-nd", "proprietary"),
}
BEGINNINGS = {b: TERMS.index(terms) for terms, many in STRICT.items() for b in many}


@functools.lru_cache(maxsize=10_000)
def strictness(name: str) -> int:
    """The place in TERMS of a licence's terms."""
    name = name.lower()
    fits = max((b for b in BEGINNINGS if name.startswith(b)), key=len, default=None)
    return len(TERMS) - 1 if fits is None else BEGINNINGS[fits]


def postfix(text: str, start: int = 0, stop: int | None = None) -> list[str] | None:
    """The longest well-formed licence expression at the start of text[start:stop], in postfix form."""
    stop = len(text) if stop is None else stop
    tokens: list[str] = []
    whole = depth = 0
    operand = True  # whether an operand must come next
    while m := TOKEN.match(text, start, stop):
        t, start = m.group(1), m.end()
        if t in ("(", ")"):
            if (t == "(") != operand or t == ")" and not depth:
                break
            depth += 1 if t == "(" else -1
        elif (t.upper() in BINDS) == operand:
            break
        else:
            operand = not operand
        tokens.append(t)
        if not operand and not depth:
            whole = len(tokens)
    return shunt(tokens[:whole]) if whole else None


def shunt(tokens: list[str]) -> list[str]:
    """Shunting-yard over the tokens of a well-formed expression."""
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        up = t.upper()
        if up in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[up]:
                out.append(stack.pop())
            stack.append(up)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            out.append(t)
    return out + stack[::-1]


def evaluate(expression: list[str]) -> tuple[str, set[str]]:
    """(terms, licences that apply) of an expression in postfix form."""
    # a node: (strictness, name or None, left, right); both sides of a choice between equals stay
    stack: list[tuple] = []
    for t in expression:
        if t not in BINDS:
            stack.append((strictness(t), t.lower(), None, None))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "OR":
            stack.append((a[0], None, a, b) if a[0] == b[0] else min(a, b, key=lambda n: n[0]))
        elif t == "AND":
            stack.append((max(a[0], b[0]), None, a, b))
        else:
            eased = a[0] - 1 if TERMS[a[0]] in ("weak-copyleft", "copyleft") else a[0]
            plain = a[1] is not None and b[1] is not None and " with " not in a[1]
            stack.append((eased, f"{a[1]} with {b[1]}", None, None) if plain else (eased, None, a, None))
    names, todo = set(), [stack[0]]
    while todo:
        _, name, a, b = todo.pop()
        if name is not None:
            names.add(name)
        todo += [n for n in (a, b) if n is not None]
    return TERMS[stack[0][0]], names


class Scanner:
    def __init__(self, base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES):
        self.automaton, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.tags.add_word(TAG, True)
        self.tags.make_automaton()
        phrases: dict[str, list[tuple[bool | None, str]]] = {f" {TAG_WORDS} ": [(None, TAG)]}
        for of_base, table in ((True, base), (False, more)):
            for phrase, label in table.items():
                phrases.setdefault(f" {phrase} ", []).append((of_base, label))
        for key, what in phrases.items():
            self.automaton.add_word(key, (len(key), what))
        self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, str]], list[str], list[str]]:
        """n_words, base places (word, label), further labels, labels of expressions (licences that apply, and terms)."""
        words = alnum_words(text or b"")
        if not words:
            return 0, [], [], []
        line = f" {b' '.join(words).decode('latin-1')} "
        places, more, tagged = [], set(), False
        last, count = 0, 0
        for end, (size, what) in self.automaton.iter(line):
            start = end - size + 1
            for of_base, label in what:
                if of_base:
                    if start >= last:
                        count += line.count(" ", last, start)
                        last = start
                        at = count
                    else:
                        at = line.count(" ", 0, start)
                    places.append((at, label))
                elif of_base is None:
                    tagged = True
                else:
                    more.add(label)
        return len(words), sorted(places), sorted(more), sorted(self.expressions(text)) if tagged else []

    def expressions(self, text: bytes) -> set[str]:
        """Labels of the expressions after all tags of a text."""
        line = text.decode("latin-1")
        ends = [end + 1 for end, _ in self.tags.iter(text.lower().decode("latin-1"))]
        labels: set[str] = set()
        for at, following in zip(ends, [*ends[1:], len(line) + len(TAG)], strict=True):
            if expression := postfix(line, at, min(following - len(TAG), len(line))):
                terms, names = evaluate(expression)
                labels |= names | {f"terms-{terms}"}
        return labels


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (word, label), labels of further phrases, labels of expressions; one pass, no shuffle."""
    view = doc_view(docs, id_col, text_col)
    id_type = view.schema["doc_id"].dataType.simpleString()
    tables = (BASE_PHRASES if base is None else base, MORE_PHRASES if more is None else more)

    def run(batches):
        scanner = Scanner(*tables)
        for batch in batches:
            for b in chunks(batch, "text"):
                rows = [scanner.scan(x) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())),
                        pa.array([r[3] for r in rows], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "places", "notices", "expressions"],
                )

    return view.mapInArrow(run, f"doc_id {id_type}, n_words bigint, places array<struct<word:bigint,label:string>>, notices array<string>, expressions array<string>")
