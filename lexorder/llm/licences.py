"""Licence scans: identifier tags, notice phrases, and the licence expressions they spell.

An Aho-Corasick automaton finds all phrases in one pass over a text's words.  There are three kinds:
names of licences, words that grant a licence ("released under"), and tags that an expression
follows.  Expressions of ``and``, ``or`` and ``with`` (in a tag's line, or between the names of a
notice: "the Apache License or the MIT License") go through a shunting-yard parser and are
evaluated: ``and`` adds obligations up to the strictest, ``or`` leaves the mildest to choose,
``with`` an exception takes one degree off.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z in lower case.  The
four base phrases are counted at every place where their words stand one after another; labels of
the other phrases and of tags are added to theirs.

``score`` is how sure it is that the text is licensed: one less the product of (1 - weight) over
the kinds of evidence found, each once (tag with a known licence, name after a grant, name alone).

Defined results: a null text is an empty one: no words, no labels, score 0.  A null id stays null.
Every row has a result of its own, repeated or not.  A tag with no valid expression counts for
nothing; of an expression that breaks off, the longest valid beginning counts.  Texts of any length
are read whole, in time that grows with the length.  Extra columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further names of licences and phrases of their notices.
NAMES = {
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "server side public license": "sspl",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
}

# Words that grant a licence, and tags that a licence expression follows.
GRANTS = ["available under", "distributed under", "licensed under", "published under",
          "released under", "subject to the terms of", "under the terms of"]
TAGS = ["spdx license identifier", "license expression"]

# Obligations: 0 keep the notice, 1 share changes of the files, 2 share the whole work,
# 3 share with users over a network, 4 no commercial use or no changes.
DEGREE = {
    "apache": 0, "artistic": 0, "bsd": 0, "bsl": 0, "cc-by": 0, "cc0": 0, "isc": 0, "mit": 0,
    "unlicense": 0, "zlib": 0,
    "epl": 1, "eupl": 1, "lgpl": 1, "mpl": 1,
    "cc-by-sa": 2, "gpl": 2,
    "agpl": 3, "sspl": 3,
    "cc-by-nc": 4, "cc-by-nc-nd": 4, "cc-by-nc-sa": 4, "cc-by-nd": 4,
}
OTHER = "other"         # a licence that a tag names and that is not known here

WEIGHTS = {"tag": 0.95, "grant": 0.9, "name": 0.5}
REACH = 6               # words from a grant to the name it grants
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# Words that may stand between the name of a licence in a notice and an operator, or the next name.
FILLERS = {"a", "an", "either", "later", "licence", "license", "of", "only", "the", "version"}

SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127
                  else 32 for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z][0-9a-z.+-]*)")
AFTER_TAG = re.compile(rb"[ \t]*:?")
VERSION = re.compile(r"(?P<family>.+?)(-v?[0-9]+(\.[0-9]+)*)?(-only|-or-later|\+)?")


def family(identifier: str) -> str:
    """The label of an identifier: without version and clauses, or ``OTHER``."""
    name = VERSION.fullmatch(identifier)["family"]
    if name.startswith(("bsd-", "0bsd")):
        name = "bsd"
    return name if name in DEGREE else OTHER


def valid_beginning(tokens: Iterator[str]) -> list[str]:
    """The longest beginning of the tokens that is a whole expression; reads no further token."""
    read, depth, good, operand = [], 0, 0, True     # operand: one is due
    before = ""
    for token in tokens:
        if operand:
            if token == "(" and before != "with":
                depth += 1
            elif token in PRECEDENCE or token in "()":
                break
            else:
                operand = False
        elif token == ")" and depth:
            depth -= 1
        elif token in PRECEDENCE and not (token == "with" and before in (")", "with exception")):
            operand = True
        else:
            break
        read.append(token)
        before = "with exception" if before == "with" else token
        if not operand and not depth:
            good = len(read)
    return read[:good]


def postfix(tokens: list[str]) -> list[str]:
    """A valid expression in postfix order, by the shunting yard; all operators are left to right."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE:
            while waiting and PRECEDENCE.get(waiting[-1], 0) >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(tokens: list[str]) -> tuple[int | None, set[str]]:
    """The degree of obligation (null where no licence is known) and the labels of an expression."""
    values: list = []
    labels: set[str] = set()
    order = postfix(tokens)
    for at, token in enumerate(order):
        if token == "with":                 # the exception is no licence
            values.pop()
            degree = values.pop()
            values.append(None if degree is None else max(degree - 1, 0))
        elif token in PRECEDENCE:
            known = [value for value in (values.pop(), values.pop()) if value is not None]
            choose = max if token == "and" else min
            values.append(choose(known, default=None))
        else:
            values.append(DEGREE.get(family(token)))
            if order[at + 1:at + 2] != ["with"]:
                labels.add(family(token))
    return values[0], labels


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces, each with its kind, label and number of words."""
    made = ahocorasick.Automaton()
    kinds = ([("base", BASE)] + [("name", NAMES)]
             + [("grant", dict.fromkeys(GRANTS))] + [("tag", dict.fromkeys(TAGS))])
    for kind, phrases in kinds:
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1, len(phrase) + 2))
    made.make_automaton()
    return made


def _hits(spaced: str) -> list[tuple[int, str, str, int]]:
    """(first word, kind, label, words) of every phrase, by first word, longer ones first."""
    found = sorted((end + 1 - size, -count, kind, label or "")
                   for end, (kind, label, count, size) in automaton().iter(spaced))
    out, at, word = [], 0, 0
    for begin, count, kind, label in found:
        word += spaced.count(" ", at, begin)
        at = begin
        out.append((word, kind, label, -count))
    return out


def _notices(hits: list, words: list[bytes]) -> Iterator[list[str]]:
    """Expressions that names of licences form with the operators between them."""
    chain: list[str] = []
    end = 0                                 # word after the last name
    for word, _, label, count in hits:
        if word < end:                      # inside a longer name
            continue
        operators = []
        if chain and word - end <= REACH:
            between = [w.decode("latin-1") for w in words[end:word]]
            # "or later" goes with the version, it joins no names.
            operators = [w for w, after in zip(between, between[1:] + [""])
                         if w in ("and", "or") and after not in ("later", "newer")]
            if any(w not in FILLERS and w not in ("and", "or", "newer") and not w.isdigit()
                   for w in between) or len(operators) != 1:
                operators = []
        if operators:
            chain += [operators[0], label]
        else:
            if chain:
                yield chain
            chain = [label]
        end = word + count
    if chain:
        yield chain


def _tagged(text: bytes, tags: list) -> Iterator[list[str]]:
    """Expressions in the lines of the tags."""
    ends = {word + count for word, _, _, count in tags}
    last = max(ends, default=0)
    for number, match in enumerate(WORD.finditer(text), 1):
        if number in ends:
            def tokens(at=AFTER_TAG.match(text, match.end()).end()):
                while token := TOKEN.match(text, at):
                    at = token.end()
                    yield token[1].decode("latin-1")
            expression = valid_beginning(tokens())
            if expression:
                yield expression
        if number >= last:
            return


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, obligation,
    expressions) of one text in UTF-8."""
    words = text.translate(SEPARATED).split()
    hits = _hits(f" {b' '.join(words).decode('latin-1')} ")
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, None, []
    base = [hit for hit in hits if hit[1] == "base"]
    names = [hit for hit in hits if hit[1] in ("base", "name")]
    grants = [word + count for word, kind, _, count in hits if kind == "grant"]
    base_labels = {label for _, _, label, _ in base}
    labels, evidence, degrees, expressions = set(base_labels), set(), [], []
    for word, _, label, _ in names:
        at = bisect_left(grants, word - REACH)      # the first grant that ends in reach of the name
        evidence.add("grant" if at < len(grants) and grants[at] <= word else "name")
        labels.add(label)
    tagged = list(_tagged(text.translate(LOWER), [h for h in hits if h[1] == "tag"]))
    for expression in [*_notices(names, words), *tagged]:
        degree, found = evaluate(expression)
        labels |= found
        expressions.append(" ".join(expression))
        if degree is not None:
            degrees.append(degree)
    if any(evaluate(expression)[0] is not None for expression in tagged):
        evidence.add("tag")
    doubt = 1.0
    for kind in sorted(evidence):
        doubt *= 1 - WEIGHTS[kind]
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - doubt,
            max(degrees, default=None), list(dict.fromkeys(expressions)))


COLUMNS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double, obligation int, expressions array<string>")


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, obligation,
    expressions) of every row."""
    rows = docs.select(docs[doc_id].alias("doc_id"), utf8(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int32(),
                                                        pa.list_(pa.string())]
        for batch in batches:
            found = [scan(body.as_py()) for body in batch.column("text")]
            columns = zip(*found) if found else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(columns, types)]],
                names=schema.names)

    return rows.mapInArrow(run, schema)
