"""License scans (operator 3).

Method: two Aho-Corasick automata, one for notice phrases over the text's words, one for
identifier tags over the raw text. The expression after a tag goes through a shunting-yard
parser, which turns and/or/with into postfix order and evaluates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice phrases of this operator, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}

#: Identifier tags that an expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "license identifier:")

#: How freely each label permits reuse, 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsl": 1.0, "apache": 0.95, "zlib": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05, "reserved": 0.0,
}
#: Of an identifier that no label fits; what an exception after ``with`` adds.
UNKNOWN, EXCEPTION = 0.2, 0.2

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:\-]+")
_VERSION = re.compile(r"-(\d[\w.]*|only|or-later|clause|international|patent)|\+$")


#: Identifiers of one plain word besides the labels; another plain word after a tag is prose.
ONE_WORD = frozenset("beerware curl expat gfdl ijg json libpng libtiff naist ncsa ntp openssl php postgresql python ruby sendmail sleepycat vim vsl wtfpl xnet zed".split())


def is_identifier(token: str) -> bool:
    """Whether a word can name a license or exception: a known name, or one with a digit, hyphen, dot or plus inside."""
    name = token.lower().rstrip(".:")
    return name in FREEDOM or name in ONE_WORD or bool(name) and not name.isalpha()


def label_of(identifier: str) -> str:
    """Family label of an identifier: GPL-2.0-or-later gives gpl, BSD-3-Clause bsd."""
    name = _VERSION.sub("", identifier.lower()).strip("-")
    return {"0bsd": "bsd", "x11": "mit", "expat": "mit"}.get(name, name)


def to_postfix(expression: str, start: int = 0, end: int | None = None) -> list[str]:
    """Postfix order of the longest well-formed prefix of a license expression, read from ``start`` to ``end``.

    Reading stops where no expression can go on (two identifiers in a row, a closing
    bracket too many, a word that is no identifier). Open brackets and operators without a right side are dropped.
    """
    out: list[str] = []
    stack: list[str] = []
    wants_operand = True
    for match in _TOKEN.finditer(expression, start, len(expression) if end is None else end):
        token = match.group()
        word = token.lower()
        if word in PRECEDENCE:
            if wants_operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            wants_operand = True
        elif token == "(":
            if not wants_operand:
                break
            stack.append("(")
        elif token == ")":
            if wants_operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not wants_operand or not is_identifier(token):
                break
            out.append(token.rstrip(".:"))
            wants_operand = False
    if wants_operand:
        while stack and (stack[-1] == "(" or stack[-1] in PRECEDENCE):
            dangling = stack.pop()
            if dangling != "(":
                break
    out.extend(x for x in reversed(stack) if x != "(")
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float | None]:
    """Labels named by the expression and its freedom: ``or`` takes the freer side,
    ``and`` the stricter, ``with`` adds an exception's allowance to its license."""
    values: list[float] = []
    labels: set[str] = set()
    exceptions = {i - 1 for i, x in enumerate(postfix) if x == "with"}
    for i, token in enumerate(postfix):
        if token in PRECEDENCE and len(values) >= 2:
            right, left = values.pop(), values.pop()
            values.append(max(left, right) if token == "or" else min(left, right) if token == "and" else min(1.0, left + EXCEPTION))
        elif token not in PRECEDENCE:
            label = label_of(token)
            if i not in exceptions and label:
                labels.add(label)
            values.append(FREEDOM.get(label, UNKNOWN))
    return labels, values[-1] if values else None


#: A-Z to lower case, word bytes as they are, all else to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class LicenseScanner:
    def __init__(self) -> None:
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase in BASE | NOTICES:
            self.phrases.add_word(f" {phrase} ", phrase)
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text."""
        words = (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()
        line = f" {b' '.join(words).decode('utf-8')} "
        starts, base, labels, freedoms, spans = [], set(), set(), [], []
        seen, before = 0, 0  # words that begin before a place of the line, kept from hit to hit
        for end, phrase in self.phrases.iter(line):
            at = end - len(phrase) - 1
            if phrase in BASE:
                before += line.count(" ", seen, at) if at >= seen else -line.count(" ", at, seen)
                seen = at
                starts.append(before)
                base.add(BASE[phrase])
            if phrase in NOTICES:
                spans.append((at, end, phrase))
        # A notice inside a longer one (cc by in cc by nc) says nothing of its own.
        labels.update(NOTICES[p] for _, _, p in _widest(spans))
        freedoms += [FREEDOM[x] for x in labels | base]
        expressions = []
        low = (text or "").lower()
        if "license" in low:
            line_end = -1
            for end, _ in self.tags.iter(low):
                if line_end <= end:
                    line_end = low.find("\n", end + 1)
                    line_end = len(low) if line_end < 0 else line_end
                postfix = to_postfix(low, end + 1, line_end)
                named, freedom = evaluate(postfix)
                labels |= named
                if freedom is not None:
                    freedoms.append(freedom)
                    expressions.append(" ".join(postfix))
        every = sorted(base | labels)
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(every), min(freedoms, default=0.0), expressions,
        )


def _widest(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans not inside another, by a sweep."""
    out, reach = [], -1
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[1] > reach:
            out.append(s)
            reach = s[1]
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions.

    ``score`` is the freedom of the strictest license found, 0 where none is. An expression
    is read to the end of its line, however long. Null and empty
    texts have no words and no labels ('' and 0); repeated rows repeat; an empty table gives
    no rows. Other columns of the input are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")
        for batch in batches:
            if not batch.num_rows:
                continue
            found = zip(*[scanner.scan(x) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(found, kinds))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>",
    )
