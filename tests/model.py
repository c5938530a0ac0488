"""Brute-force answers for small texts (bytes or tuples of integers)."""

import random


def suffix_array(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def minus(text):
    return [text[i:] > text[i + 1:] for i in range(len(text))]


def stars(text):
    """Minus-star and plus-star positions."""
    flags = minus(text)
    return ([i for i in range(1, len(text)) if flags[i] and not flags[i - 1]],
            [i for i in range(1, len(text)) if not flags[i] and flags[i - 1]])


def substrings(text):
    """(star_idx, pos, end_pos, terminal, sub) of every minus-star."""
    at, _ = stars(text)
    ends = at[1:] + [len(text) - 1]
    return [(k, p, e, k == len(at) - 1, text[p:e + 1]) for k, (p, e) in enumerate(zip(at, ends))]


def names(text):
    keys = [(sub, not terminal) for _, _, _, terminal, sub in substrings(text)]
    order = sorted(set(keys))
    return [order.index(key) for key in keys]


GOLDEN = {
    b"banana": ([5, 3, 1, 0, 4, 2], "-+-+--", [2, 4], [1, 3], [1, 0]),
    b"mississippi": ([10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2], "-+--+--+---", [2, 5, 8], [1, 4, 7],
                     [2, 1, 0]),
    b"abracadabra": ([10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2], "++-+-+-++--", [2, 4, 6, 9], [3, 5, 7],
                     [3, 0, 1, 2]),
    b"abcabcabc": ([6, 3, 0, 7, 4, 1, 8, 5, 2], "++-++-++-", [2, 5, 8], [3, 6], [1, 1, 0]),
    b"aaaa": ([3, 2, 1, 0], "----", [], [], []),
    b"a": ([0], "-", [], [], []),
    b"dcba": ([3, 2, 1, 0], "----", [], [], []),
    b"\x00\xff\x7f\x80\xff": ([0, 2, 3, 4, 1], "+-++-", [1, 4], [2], [1, 0]),
    b"": ([], "", [], [], []),
}


def sample_texts(seed, count=40):
    """Golden texts, runs, periods and random texts over one to four symbols."""
    rng = random.Random(seed)
    texts = list(GOLDEN) + [b"a" * 90, b"ab" * 45, b"abc" * 20 + b"abd" * 10,
                            b"b" + b"a" * 40 + b"b" * 40 + b"a" * 40 + b"c" + b"a" * 8]
    for _ in range(count):
        letters = b"ab\xff\x00"[:rng.randint(1, 4)]
        texts.append(bytes(rng.choices(letters, k=rng.randint(1, 60))))
    return texts


def grouped(rows, value):
    """Values per text id, in row order."""
    out = {}
    for row in rows:
        out.setdefault(row.text_id, []).append(value(row))
    return out
