import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexorder.llm import lattice_lm as L

from .data import CLASHES, frame, some_documents


def test_lattice_against_all_segmentations():
    names = sorted({b" a", b"b", b"ab", b"ba", b"aba", b" ab", b" abba"}
                   | {bytes([i]) for i in range(256)})
    rng = np.random.default_rng(1)
    p = rng.random(len(names))
    lattice = L.Lattice(names, np.log(p / p.sum()))
    known = dict(zip(names, p / p.sum()))

    def total(word):
        if not word:
            return 1.0
        return sum(known.get(word[:n], 0) * total(word[n:]) for n in range(1, len(word) + 1))

    words = [b" a", b" ab", b" abba", b" abababba", b" " + "é".encode(), b" b"]
    got, _ = lattice.forward(lattice.arcs(words))
    assert np.allclose(np.exp(got), [total(w) for w in words])

    def segmentations(word):
        if not word:
            yield ()
        for n in range(1, len(word) + 1):
            if word[:n] in known:
                yield from ((word[:n], *rest) for rest in segmentations(word[n:]))

    times = np.array([1.0, 2, 3, 4, 5, 6])
    expected = Counter()
    for word, n in zip(words, times):
        for cut in segmentations(word):
            share = math.prod(known[x] for x in cut) / total(word)
            for x in cut:
                expected[x] += n * share
    counts = lattice.expected(words, times)
    assert np.allclose(counts, [expected[n] for n in names])


def test_chained_table_finds_all():
    names = sorted({bytes([i]) for i in range(256)} | {bytes([i, j]) for i in range(256)
                                                       for j in range(128)})
    lattice = L.Lattice(names, np.full(len(names), -1.0))
    codes = np.array([L._code(n) for n in names], dtype=np.uint64)
    assert np.array_equal(lattice._pieces(codes.copy()), np.arange(len(names)))


@pytest.fixture(scope="module")
def scored(spark):
    rows = some_documents()
    # Few words are sent to all tasks, so that most go through the join.
    return rows, L.score_texts(frame(spark, rows, CLASHES), head=64, rounds=1).collect()


def test_base_against_brute_force(scored):
    rows, got = scored
    trains = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    for r in rows:
        if trains(r[0]):
            counts.update(tokens(r[1]))
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        expected.append((str(r[0]), r[0] is not None and not trains(r[0]), len(own),
                         sum(counts[w] > 0 for w in own), total, round(base, 6)))
    assert sorted(expected) == sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
         round(r["base_score"], 6)) for r in got)


def test_scores_do_not_depend_on_the_way(scored, spark):
    rows, got = scored
    again = L.score_texts(frame(spark, rows), rounds=1).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 6))
    assert sorted(map(key, got)) == sorted(map(key, again))
    for r in got:
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_score_against_the_definition(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(
        ["the cat", "The cat sat", "a dog sat", "the end of the cat", "zebra qq"] * 3)]
    got = L.score_texts(frame(spark, rows), rounds=0).collect()
    names, log_p = L.load_pieces()
    known = dict(zip(names, np.exp(log_p)))

    def spelled(word):
        alpha = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            alpha[end] = sum(alpha[b] * known.get(word[b:end], 0) for b in range(end))
        return alpha[-1]

    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 10:
            counts.update([*r[1].encode().lower().split(), b""])
    n = sum(counts.values())
    e = (sum(c == 1 for w, c in counts.items() if w) + 1) / (n + 1)
    q = (counts[b""] + 1) / (n + 2)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        wanted = mixed = 0.0
        for w in [*texts[r["doc_id"]].encode().lower().split(), b""]:
            own = q if w == b"" else (1 - q) * spelled(b" " + w)
            wanted += math.log10(own)
            mixed += math.log10((1 - e) * counts[w] / n + e * own)
        assert abs(wanted - r["score"]) < 1e-9
        assert abs(mixed - r["word_score"]) < 1e-9


def test_score_is_the_sum_over_all_segmentations_of_the_text(spark):
    """Known words, too, are scored by their pieces: every way to cut the whole text counts."""
    rows = [(i, "abab ba", "en", "s", 1) for i in range(20)]
    got = L.score_texts(frame(spark, rows), rounds=1).collect()
    assert len({round(r["score"], 9) for r in got}) == 1
    names, log_p = L.load_pieces()
    trained = sum(zlib.crc32(str(r[0]).encode()) % 10 != 0 for r in rows)
    words = spark.createDataFrame([(b"abab", trained), (b"ba", trained)], "word binary, c long")
    known = dict(zip(names, np.exp(L.fit_pieces(words, names, log_p, 1))))

    def cuts(word):
        if not word:
            yield 1.0
        for n in range(1, len(word) + 1):
            if word[:n] in known:
                yield from (known[word[:n]] * rest for rest in cuts(word[n:]))

    q = (trained + 1) / (3 * trained + 2)
    text = sum(a * b for a in cuts(b" abab") for b in cuts(b" ba")) * (1 - q) ** 2 * q
    assert abs(math.log10(text) - got[0]["score"]) < 1e-9


def test_fitting_raises_the_likelihood(spark):
    words = spark.createDataFrame([(w.encode(), n) for w, n in
                                   [("theing", 50), ("ingthe", 30), ("xing", 5), ("thethe", 9)]],
                                  "word binary, c long")
    names, before = L.load_pieces()
    after = L.fit_pieces(words, names, before, 2)

    def total(log_p):
        lattice = L.Lattice(names, log_p)
        own = [(b" " + bytes(r[0]), r[1]) for r in words.collect()]
        got, _ = lattice.forward(lattice.arcs([w for w, _ in own]))
        return sum(g * n for g, (_, n) in zip(got, own))

    assert total(after) > total(before)
    assert abs(np.exp(after).sum() - 1) < 1e-9


def test_empty_table_and_no_training_rows(spark):
    assert L.score_texts(frame(spark, [])).collect() == []
    got = L.score_texts(frame(spark, [(None, "some words", "en", "s", 1)])).collect()[0]
    assert got["train_tokens"] == 0 and got["base_score"] == 0 and math.isfinite(got["score"])
