import itertools
import random
import re

import pytest

from lexorder.llm import licences as L

from .data import CLASHES, frame, some_documents

NOTICES = ["This work is licensed under the GNU General Public License, version 3.",
           "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
           "Licensed under the Apache License, Version 2.0.", "gnu  GENERAL\npublic-license",
           "Mit license mit LICENSE", "mit\x00license", "cc by", "cc byé", "xcc by",
           "// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT */"]


def base_of(text):
    """The contract's columns by the words themselves."""
    lower = "".join(c.lower() if c < "\x7f" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in [("gnu general public license", "gpl"), ("apache license", "apache"),
                          ("cc by", "cc-by"), ("mit license", "mit")]:
        phrase = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(phrase)] == phrase:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def test_base_against_brute_force(spark):
    rng = random.Random(3)
    rows = some_documents()
    pieces = NOTICES + ["gnu", "general", "public", "license", "cc", "by", "apache", "mit", "and"]
    for i in range(300):
        text = rng.choice([" ", "\n", ", "]).join(rng.choices(pieces, k=rng.randint(1, 12)))
        rows.append((20_000 + i, text, "en", "s", 1))
    rows.append((30_000, "mit license " * 20_000, "en", "s", 1))
    found = L.scan_licences(frame(spark, rows, CLASHES)).collect()
    expected = sorted(((r[0], *base_of(r[1])) for r in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in found), key=repr) == expected
    for row in found:
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score > 0) == (row.labels != "")


@pytest.mark.parametrize("text, labels, obligation", [
    ("SPDX-License-Identifier: MIT", "mit", 0),
    ("SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND MPL-2.0", "gpl,mit,mpl", 1),
    ("SPDX-License-Identifier: MIT OR GPL-3.0-only AND MPL-2.0", "gpl,mit,mpl", 0),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl", 1),
    ("x\n# SPDX-License-Identifier: Apache-2.0 AND\nmore", "apache", 0),
    ("SPDX-License-Identifier: LicenseRef-own", "other", None),
    ("SPDX-License-Identifier:", "", None),
    ("SPDX-License-Identifier: ((MPL-2.0", "", None),
    ("License-Expression: AGPL-3.0+", "agpl", 3),
    ("under the Apache License, Version 2.0 or the MIT license at your option", "apache,mit", 0),
    ("the Mozilla Public License and the GNU Lesser General Public License", "lgpl,mpl", 1),
    ("GNU General Public License version 2 or later", "gpl", 2),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 4),
    ("a license to kill; the public domain of general ideas", "", None),
])
def test_labels_and_obligations(text, labels, obligation):
    found = L.scan(text.encode())
    assert (found[5], found[7]) == (labels, obligation)


def test_grant_is_surer_than_name():
    alone, granted, tagged = (L.scan(text)[6] for text in (
        b"the MIT License", b"released under the MIT License", b"SPDX-License-Identifier: MIT"))
    assert 0 < alone < granted < tagged <= 1


def by_python(tokens):
    """The degree by Python's own operators, where | binds less than &."""
    class Degree(int):
        __and__ = lambda a, b: Degree(max(a, b))
        __or__ = lambda a, b: Degree(min(a, b))     # noqa: E731
    known = {"and": "&", "or": "|", "(": "(", ")": ")"} | {
        label: f"D({degree})" for label, degree in L.DEGREE.items()}
    python = " ".join(known[t] for t in tokens)
    return int(eval(python, {"D": Degree}))


def test_shunting_yard_against_python():
    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(["mit", "gpl", "mpl", "agpl"])]
        inner = [*made(depth - 1), rng.choice(["and", "or"]), *made(depth - 1)]
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(500):
        tokens = made(5)
        assert L.valid_beginning(iter(tokens)) == tokens
        assert L.evaluate(tokens)[0] == by_python(tokens)


def test_valid_beginning_against_all_beginnings():
    def valid(tokens):
        try:
            compile(" ".join({"and": "&", "or": "|"}.get(t, t) for t in tokens), "", "eval")
        except SyntaxError:
            return False
        return "( )" not in " ".join(tokens) and not re.search(r"[a-z)] \(", " ".join(
            "&" if t in ("and", "or") else t for t in tokens))

    for tokens in itertools.product(["a", "and", "or", "(", ")"], repeat=6):
        longest = max((k for k in range(7) if k == 0 or valid(tokens[:k])), default=0)
        assert len(L.valid_beginning(iter(tokens))) == longest, tokens


def test_deep_and_long_expressions_are_linear():
    deep = b"SPDX-License-Identifier: " + b"(" * 100_000 + b"MIT" + b")" * 100_000
    assert L.scan(deep)[5] == "mit"
    assert L.scan(b"SPDX-License-Identifier: MIT " * 50_000)[5] == "mit"


def test_empty_table(spark):
    assert L.scan_licences(frame(spark, [])).collect() == []
