"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; expressions are parsed by shunting-yard.

Texts stay in the partitions they are read in: the automaton is built once per task from a fixed phrase table, so
the scan is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Phrases that the scan adds, and their labels.
MORE_PHRASES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
    "cc by nc sa 4 0": "cc-by-nc-sa",
    "cc by nd 4 0": "cc-by-nd",
    "creative commons": "creative-commons",
    "all rights reserved": "proprietary",
}

#: Words before a license name that make it a grant rather than a mention.
GRANT_PHRASES = ("licensed under", "released under", "distributed under", "under the terms of")

#: Identifier families that allow reuse in a training corpus; a WITH exception keeps its license's answer.
ALLOWED = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "cc-by-4.0", "isc", "mit", "unlicense", "zlib")

TAG = "spdx-license-identifier:"
#: Every byte that is no word byte becomes a blank; A-Z become a-z; bytes from 0x80 are parts of words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: What ends a tag's value; a quotation mark or a tag of markup may stand behind one too.
_VALUE_END = re.compile(r"[\r\n]|\*/|-->|#}|%>|\?>|</|\"")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order by the shunting-yard algorithm, or None if it is malformed.

    ``with`` binds tightest, then ``and``, then ``or``; operators of the same rank go from left to right.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what must come next
    simple: str | None = None  # the license just read
    if _TOKEN.sub("", expression).strip():
        return None  # marks that no expression holds
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
            simple = None
        elif low in _RANK:
            if operand or low == "with" and simple is None:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
            simple = None if low == "with" else simple
        else:
            if not operand:
                return None
            # an exception follows a license, neither a bracket nor another exception
            simple = None if stack and stack[-1] == "with" else low
            out.append(low)
            operand = False
    if operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def allows(expression: str, allowed: tuple[str, ...] = ALLOWED) -> bool | None:
    """Whether the expression lets the text be reused under ``allowed``: ``or`` needs one side, ``and`` both. None: malformed."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left and right if token == "and" else left or right)
        else:
            stack.append(token.rstrip("+") in allowed)
    return stack[0]


def tag_expression(text: str, at: int, end: int) -> str:
    """The value of a tag that ends at ``at``: what follows on its line, up to the mark that ends a comment or to ``end``, the next tag.

    Nothing is cut off that the parser might refuse.
    """
    m = _VALUE_END.search(text, at, end)
    return text[at : m.start() if m else end].strip()


def _automaton(phrases: dict[str, tuple]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase), value))
    found.make_automaton()
    return found


def scan_text(text: str | None, automaton, tags) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expression, allowed) of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_base, first, last = 0, None, None
    base, labels, granted = set(), set(), []
    for end, (length, (kind, label)) in automaton.iter(line):
        start = end - length - 1
        if kind == "grant":
            granted.append(end)
            continue
        if kind == "base":
            n_base += 1
            base.add(label)
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
        labels.add(label)
    expressions = []
    if "spdx" in line:
        low = raw.lower().decode("utf-8", "surrogatepass")
        whole = raw.decode("utf-8", "surrogatepass")
        if len(low) == len(whole):
            ends = [end + 1 for end, _ in tags.iter(low)]
            stops = [e - len(TAG) for e in [*ends[1:], len(whole) + len(TAG)]][: len(ends)]
            expressions = [tag_expression(whole, e, stop) for e, stop in zip(ends, stops, strict=True)]
    answers = [allows(e) for e in expressions]
    allowed = [bool(a) for a in answers]  # a tag that does not parse allows nothing
    parsed = any(a is not None for a in answers)
    for e in expressions:
        postfix = to_postfix(e) or []
        # of an exception and its license, which stand before their operator, only the license is one
        exceptions = {i - 1 for i, x in enumerate(postfix) if x == "with"}
        labels.update(f"spdx:{x}" for i, x in enumerate(postfix) if x not in _RANK and i not in exceptions)
    score = 1.0 if parsed else (0.9 if labels and granted else 0.5 if labels or answers else 0.0)
    place = lambda at: None if at is None else line.count(" ", 0, at)
    return (
        len(words), n_base, place(first), place(last), ",".join(sorted(base)), ",".join(sorted(labels | base)), score,
        " | ".join(expressions) or None, all(allowed) if allowed else None,
    )


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, allowed boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scans each row's whole text: (key, counts and places of base phrases, labels, score, tag expressions and their answer).

    Words are ``[0-9a-z\\x80-]+`` after lower-casing A-Z. ``n_base`` counts all places of base phrases, overlaps
    included; ``first_word`` and ``last_word`` are the smallest and largest start of such a place in words from 0,
    null without one. ``labels`` holds the base labels, the labels of further phrases and ``spdx:`` identifiers of
    tags that parse. ``score`` is 1 with a tag that parses, else 0.9 with a label and a grant wording, 0.5 with a label
    or a tag only, else 0. ``expression`` joins the tags' values (a value goes to the end of
    its line or comment, however long), and ``allowed`` tells whether all of them parse and permit reuse (null without
    a tag). A null or empty text has no words, labels '' and score 0; repeated rows give repeated results; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = {p: ("base", v) for p, v in BASE_PHRASES.items()} | {p: ("more", v) for p, v in MORE_PHRASES.items()} | {p: ("grant", "") for p in GRANT_PHRASES}
        automaton = _automaton(phrases)
        tags = ahocorasick.Automaton()
        tags.add_word(TAG, True)
        tags.make_automaton()
        for batch in batches:
            rows = zip(*[scan_text(t.as_py(), automaton, tags) for t in batch.column(1)], strict=True) if batch.num_rows else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(r), kind) for r, kind in zip(rows, KINDS, strict=True))], names=["key", *NAMES])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, {SCHEMA}")
    return found.withColumnRenamed("key", key)
