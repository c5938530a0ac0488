import math
import random

import numpy as np
import pytest

from lexorder.llm import whitening as W

CLASHES = ["x", "dimension", "part", "r", "n", "at"]


def table(spark, rows, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    return df.select("*", *[F.lit(f"extra {name}").alias(name) for name in extra])


def brute(rows, components=16):
    """Per vec_id and row: the contract's figures by numpy's own solver, signs left open."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dimension in {len(x) for _, x in usable}:
        fit = {tuple(x) for _, x in usable if len(x) == dimension}
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([s / n for s in sums])
        centred = np.array(sorted(fit)) - mean
        values, v = np.linalg.eigh(centred.T @ centred / n)
        values, v = values[::-1], v[:, ::-1]
        rank = min(n - 1, np.linalg.matrix_rank(centred)) if n > 1 else 0
        for i, x in usable:
            if len(x) == dimension:
                deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
                out.setdefault(i, []).extend(
                    (k + 1, n, deviation, abs((np.array(x) - mean) @ v[:, k])
                     / math.sqrt(values[k]), values[k] / values.sum())
                    for k in range(min(components, rank)))
    return out


def check(df, rows, distinct=True):
    found = {}
    for r in df.collect():
        assert r.identity_error <= 1e-9
        found.setdefault(r.vec_id, []).append(
            (r.component, r.n, r.deviation, abs(r.whitened), r.explained))
    expected = {i: sorted(v) for i, v in brute(rows).items() if v}
    assert found.keys() == expected.keys()
    for i, mine in found.items():
        mine = sorted(mine)
        assert [m[:3] for m in mine] == [e[:3] for e in expected[i]]
        assert [m[4] for m in mine] == pytest.approx([e[4] for e in expected[i]], rel=1e-9)
        if distinct:
            assert [m[3] for m in mine] == pytest.approx([e[3] for e in expected[i]],
                                                         rel=1e-6, abs=1e-7)


def vectors(seed, n, dimension):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, dimension)) @ np.diag(np.linspace(0.1, 3, dimension))
    return [(i, [float(c) for c in row]) for i, row in enumerate(mixed)]


def test_against_numpy(spark):
    rows = vectors(1, 400, 20)
    rows += [(1000, None), (1001, []), (1002, [None] * 20), (1003, [float("nan")] * 20),
             (1004, [math.inf] + [0.0] * 19), (None, rows[5][1]), rows[6], rows[6],
             (1005, [1.0] * 20)] + [(2000 + i, rows[7][1]) for i in range(300)]
    df = W.whiten(table(spark, rows, CLASHES))
    check(df, rows)
    # One sign for all rows: the projections of two rows differ by the same direction.
    first = {(r.vec_id, r.component): r.whitened for r in df.collect()}
    fit = np.array(sorted({tuple(math.floor(64 * np.float32(c)) for c in v) for i, v in rows
                           if i is not None and i not in range(1000, 1005)}))
    assert len(fit) == df.first().n
    sums = {k: sum(first[i, k] for i in [*range(400), 1005]) for k in range(1, 17)}
    assert all(abs(s) < 1e-6 for s in sums.values())      # whitened columns are centred


def test_lengths_of_their_own_and_low_rank(spark):
    rows = vectors(2, 50, 6) + [(100 + i, v) for i, v in vectors(3, 3, 8)] + [(200, [1.0, 2.0])]
    rows += [(300 + i, [float(i % 7), float(i % 5), 2.0 * (i % 7), 1.0, 0.0]) for i in range(60)]
    check(W.whiten(table(spark, rows)), rows)


def test_equal_eigenvalues(spark):
    signs = [(s, t, u) for s in (-1.0, 1.0) for t in (-1.0, 1.0) for u in (-1.0, 1.0)]
    rows = [(i, list(v)) for i, v in enumerate(signs)]
    check(W.whiten(table(spark, rows)), rows, distinct=False)


def test_extreme_entries(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 3.0]), (3, [5.0, 5.0])]
    found = W.whiten(table(spark, rows)).collect()
    assert {r.vec_id for r in found} == {0, 1, 2, 3}
    assert all(r.deviation is None for r in found if r.vec_id < 2)


def test_empty_table_and_one_vector(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 64])
def test_singular_values_keep_relative_accuracy(size):
    rng = np.random.default_rng(size)
    diagonal = 10.0 ** rng.uniform(-12, 2, size)
    above = 10.0 ** rng.uniform(-12, 2, size - 1)
    found = W.dqds(diagonal, above)
    # The product of the values is that of the diagonal: only accurate small values keep it.
    assert np.log(found).sum() == pytest.approx(2 * np.log(diagonal).sum(), abs=1e-9)
    dense = np.diag(diagonal) + np.diag(above, 1)
    assert np.sqrt(found) == pytest.approx(np.linalg.svd(dense, compute_uv=False),
                                           abs=1e-13 * np.abs(dense).max() * size)


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "clusters", "singular", "zero rows"])
def test_solver_against_svd(kind):
    rng = np.random.default_rng(11)
    for size in (1, 2, 3, 9, 40):
        u, _ = np.linalg.qr(rng.standard_normal((size, size)))
        v, _ = np.linalg.qr(rng.standard_normal((size, size)))
        s = {"random": rng.uniform(1, 2, size), "graded": 10.0 ** -rng.uniform(0, 6, size),
             "equal": np.ones(size), "singular": np.r_[np.ones(size - size // 2),
                                                       np.zeros(size // 2)],
             "clusters": 1 + 1e-9 * rng.integers(0, 3, size), "zero rows": np.ones(size)}[kind]
        a = u @ np.diag(s) @ v.T
        if kind == "zero rows":
            a[size // 2:] = 0
        r = np.linalg.qr(a, mode="r")
        values, directions, trace = W.principal(r, 1, size)
        known = np.linalg.svd(a, compute_uv=False) ** 2
        known = known[known > 1e-20]
        assert len(values) == len(known)
        assert values == pytest.approx(known, rel=1e-8)
        assert trace == pytest.approx((a ** 2).sum())
        assert np.abs(directions.T @ directions - np.eye(len(values))).max(initial=0) < 1e-10
        white = a @ directions / np.sqrt(values)
        assert np.abs(white.T @ white - np.eye(len(values))).max(initial=0) < 1e-6


def test_random_bidiagonals_have_orthonormal_vectors():
    random.seed(1)
    for seed in range(30):
        rng = np.random.default_rng(seed)
        size = random.randint(1, 30)
        d, e = rng.standard_normal(size), rng.standard_normal(size - 1)
        e[rng.random(size - 1) < 0.2] = 0
        values = W.dqds(d, e)
        z = W.right_vectors(d, e, values)
        b = np.diag(d) + np.diag(e, 1)
        assert np.abs(z.T @ z - np.eye(size)).max() < 1e-8
        assert np.abs(b.T @ b @ z - z * values).max() < 1e-8 * max(values)
