import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from lexorder.llm import spelling as S

from .data import CLASHES, frame, rows_of, some_documents


def edits(word):
    """What a word is with a code point less, and with one masked: near words share one."""
    for i in range(len(word)):
        yield word[:i] + word[i + 1:], None
        yield word[:i] + word[i + 1:], i


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {word: times for word, times in n.items() if times >= 2}
    shared = defaultdict(set)
    for word in n:
        for key in edits(word):
            shared[key].add(word)
            shared[key[0], None].add(word) if key[1] is None else None
        shared[word, None].add(word)
    partners = {word: set() for word in n}
    for group in shared.values():
        for a in group:
            partners[a] |= {b for b in group if near(a, b)}
    form = {}
    for word, others in partners.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[word] = best if best and n[best] >= 10 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n[word], len(partners[word]), n.get(form[word])))
    return sorted(out, key=repr)


def planted(seed=5):
    """Texts with frequent words, variants of them, and variants of the variants."""
    rng = random.Random(seed)
    rows = some_documents(seed)
    for i in range(60):
        stem = "".join(rng.choices("abcdeé×ÿ", k=rng.randint(7, 10)))
        chain, times = [], rng.choice([300, 1000])
        while times >= 2:
            chain += [stem] * times
            at = rng.randrange(len(stem))
            stem = rng.choice([stem[:at] + "q" + stem[at:], stem[:at] + "z" + stem[at + 1:],
                               stem[:at] + stem[at + 1:]])
            times //= rng.choice([9, 10, 12])
        rng.shuffle(chain)
        rows += [(5000 + 10 * i + k, " ".join(chain[k::3]).title() if k else "-".join(chain[::3]),
                  "en", "s", 1) for k in range(3)]
    return rows


def test_against_brute_force(spark):
    rows = planted()
    expected = brute(rows)
    assert rows_of(S.spelling_forms(frame(spark, rows, CLASHES))) == expected
    assert sum(e[1] is not None and e[2] != e[1] for e in expected) >= 5     # chains of forms
    assert rows_of(S.spelling_forms(frame(spark, rows), classes=5)) == expected


def test_crowded_blocks_are_cut(spark, monkeypatch):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randint(7, 8))) for _ in range(900)}
    rows = [(i, " ".join(rng.sample(sorted(words), len(words))), "en", "hot", 1) for i in range(3)]
    monkeypatch.setattr(S, "GROUP_ROWS", 100)
    assert rows_of(S.spelling_forms(frame(spark, rows))) == brute(rows)


def test_pairs_against_edits():
    rng = random.Random(7)
    for length in (1, 2, 9):
        left = sorted({"".join(rng.choices("abÿ", k=length)) for _ in range(90)})
        for less in (0, 1):
            right = sorted({"".join(rng.choices("abÿ", k=length - less)) for _ in range(90)})
            found = {(left[i], right[j])
                     for a, b in S.near_pairs(S._letters(left, length),
                                              S._letters(right, length - less))
                     for i, j in zip(a, b)}
            assert found == {(a, b) for a in left for b in right if near(a, b)}


def test_very_long_words():
    word = np.frombuffer(b"x" * 30_000, np.uint8)[None]
    other = word.copy()
    other[0, 777] = 121
    assert len(list(S.near_pairs(word, other))) == 1
    assert len(list(S.near_pairs(word, word[:, 1:]))) == 1
    assert not list(S.near_pairs(word, word))


def test_empty_tables(spark):
    assert S.spelling_forms(frame(spark, [])).collect() == []
    assert S.spelling_forms(frame(spark, [(1, None, "en", "s", 1), (2, "short", "en", "s", 1)])
                            ).collect() == []
