import random

import pytest

from lexorder.operators import compare
from lexorder.operators.compare import compare_suffixes, neighbour_agreement
from lexorder.plans.suffix_array import sort_texts
from lexorder.sources.texts import chunk_texts
from tests import model


def agreement(a, b):
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n, (a > b) - (a < b)


def made_texts(seed):
    rng = random.Random(seed)
    base = bytes(rng.choices(b"ab", k=300))
    other = bytearray(base)
    other[211] = 0
    return [base, bytes(other), base[50:] + base, b"a" * 260, b"a" * 200 + b"b", b"x", base * 2]


@pytest.mark.parametrize("shape, look", [((64, 16), 4), ((1024, 64), 16)])
def test_against_python(spark, shape, look):
    texts = made_texts(1)
    rng = random.Random(2)
    pairs = [(0, 0, 1, 0), (0, 50, 2, 0), (3, 0, 3, 1), (3, 60, 4, 0), (5, 0, 5, 0), (6, 0, 6, 300),
             (0, 0, 6, 0), (6, 300, 0, 0), (3, 259, 4, 199)]
    for _ in range(150):
        a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
        pairs.append((a, rng.randrange(len(texts[a])), b, rng.randrange(len(texts[b]))))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    packed = chunk_texts(df, "id", "t", chunk=shape[0], halo=shape[1])
    asked = spark.createDataFrame(pairs, "text_a long, pos_a long, text_b long, pos_b long")
    got = sorted(tuple(r) for r in compare_suffixes(asked, packed, look=look).collect())
    assert got == sorted((a, i, b, j, *agreement(texts[a][i:], texts[b][j:]))
                         for a, i, b, j in pairs)


def test_deceiving_hashes_are_found_out(spark, monkeypatch):
    """With hashes that are all alike the symbols alone decide."""
    monkeypatch.setattr(compare, "PRIMES", (1, 1))
    texts = made_texts(3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    packed = chunk_texts(df, "id", "t", chunk=64, halo=16)
    pairs = [(0, 0, 1, 0), (0, 3, 6, 3), (3, 0, 4, 0), (0, 0, 3, 0)]
    asked = spark.createDataFrame(pairs, "text_a long, pos_a long, text_b long, pos_b long")
    got = sorted(tuple(r) for r in compare_suffixes(asked, packed, look=4).collect())
    assert got == sorted((a, i, b, j, *agreement(texts[a][i:], texts[b][j:]))
                         for a, i, b, j in pairs)


def test_neighbours_in_rank_order(spark):
    texts = [b"mississippi", b"banana", b"a" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    packed = chunk_texts(df, "id", "t", chunk=8, halo=4)
    found = neighbour_agreement(sort_texts(packed), packed, look=4).collect()
    for i, text in enumerate(texts):
        sa = model.suffix_array(text)
        got = sorted((r.rank, r.pos, r.agree, r.sign) for r in found if r.text_id == i)
        assert got == [(k, p, agreement(text[p:], text[sa[k - 1]:])[0] if k else 0, 1)
                       for k, p in enumerate(sa)]


def test_no_pairs(spark):
    packed = chunk_texts(spark.createDataFrame([(0, b"abc")], "id long, t binary"), "id", "t")
    none = spark.createDataFrame([], "text_a long, pos_a long, text_b long, pos_b long")
    assert compare_suffixes(none, packed).collect() == []
