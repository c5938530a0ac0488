import random

import numpy as np
from pyspark.sql import functions as F

from lexorder.llm import neighbours as A
from lexorder.staging import Stages


def table(spark, rows, extra=()):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(
        "*", *[F.lit("extra").alias(n) for n in extra]).repartition(3)


def brute(rows, asks, top=20):
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows
              if i is not None and v is not None and None not in v and len(v) == 8
              and np.isfinite(v).all() and np.any(v)]
    out = set()
    for i, q in usable:
        if asks(i):
            near = sorted((-float((q * v).sum()), j) for j, v in usable if j != i)
            out |= {(i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(near[:top], 1)}
    return out


def some_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(n)]
    rows += [(1000 + i, rows[4][1], 0) for i in range(70)]       # a common vector
    rows += [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [1.0, None] + [0.0] * 6, 0),
             (2060, [float("nan")] * 8, 0), (2080, [float("inf")] + [1.0] * 7, 0),
             (2100, [1.0, 2.0], 0), (None, rows[0][1], 0), (2120, [0.001] * 8, 0),
             (2140, [30.0] + [0.0] * 7, 0)]
    return rows


def got(df, top=20, **how):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in
            A.neighbours(df, F.col("id") % 20 == 0, top=top, **how).collect()}


def test_recall_and_ties(spark):
    rows = some_rows()
    expected = brute(rows, lambda i: i % 20 == 0)
    found = got(table(spark, rows, ["id", "point", "bucket", "n"]))
    assert len(found) == len(expected)
    pairs = lambda rows: {(q, v) for q, _, v, _ in rows}
    assert len(pairs(found) & pairs(expected)) >= 0.9 * len(expected)


def test_every_bucket_visited_is_exact(spark, monkeypatch):
    monkeypatch.setattr(A, "RECALL", 1.0)
    monkeypatch.setattr(A, "fit_probes", lambda *a, **k: 100_000)
    rows = some_rows()
    # Small blocks, so that buckets and their visitors are split.
    assert got(table(spark, rows), block=16) == brute(rows, lambda i: i % 20 == 0)


def test_best_of_many_ties_are_the_first():
    rng = np.random.default_rng(4)
    points = (rng.random((1200, 24)) < 4 / 24).astype(float)
    queries = points[::100]
    query, point, score = A.best_of(queries, points, 21)
    for q in range(len(queries)):
        exact = points @ queries[q]
        expected = sorted(range(len(points)), key=lambda i: (-exact[i], i))[:21]
        assert point[query == q].tolist() == expected
        assert score[query == q].tolist() == exact[expected].tolist()


def test_tied_binary_vectors_go_to_smaller_ids(spark, monkeypatch):
    """1,199 vectors of four ones: dozens share each score, and the ids must be the least."""
    rng = random.Random(6)
    rows = []
    for i in range(1199):
        ones = set(rng.sample(range(24), 4))
        rows.append((1199 - i, [float(c in ones) for c in range(24)], 0))
    usable = [(i, np.array(v)) for i, v, _ in rows]
    expected = set()
    for i, q in usable:
        if i % 100 == 0:
            near = sorted((-float(q @ v), j) for j, v in usable if j != i)[:20]
            expected |= {(i, n, j, -s) for n, (s, j) in enumerate(near, 1)}
    monkeypatch.setattr(A, "fit_probes", lambda *a, **k: 100_000)
    found = {tuple(r) for r in A.neighbours(table(spark, rows), F.col("id") % 100 == 0,
                                            block=256).collect()}
    assert found == expected


def test_few_and_none(spark):
    assert got(table(spark, [])) == set()
    assert got(table(spark, [(0, None, 0), (20, [0.0], 0)])) == set()
    assert got(table(spark, [(0, [1.0] * 8, 0)])) == set()
    rows = [(0, [1.0] * 8, 0), (1, [2.0] * 8, 0), (20, [1.0] * 8, 0)]
    assert got(table(spark, rows)) == brute(rows, lambda i: i % 20 == 0)


def test_queries_of_sparse_regions_get_all_their_neighbours(spark, monkeypatch):
    """One visit serves a dense cluster, but not the queries around it."""
    rng = random.Random(3)
    rows = [(i, [5 + rng.gauss(0, 0.001) for _ in range(8)], 0) for i in range(1, 3000)]
    rows += [(20_000 + 20 * i, [rng.gauss(0, 5) for _ in range(8)], 0) for i in range(40)]
    monkeypatch.setattr(A, "fit_probes", lambda *a, **k: 1)
    monkeypatch.setattr(A, "BUCKET_POINTS", 4)
    found = A.neighbours(table(spark, rows), F.col("id") >= 20_000).groupBy("query_id").count()
    assert sorted(map(tuple, found.collect())) == [(20_000 + 20 * i, 20) for i in range(40)]


def test_visits_come_in_order():
    rng = np.random.default_rng(2)
    place = rng.uniform(-3, 3, 4)
    visits = A._sequence(place, 7 ** 4)
    assert len(visits) == len(set(visits)) == 7 ** 4
    inside = place - np.floor(place)

    def cost(bucket):
        step = np.array(bucket) - np.floor(place).astype(int)
        return sum((x + -s - 1) ** 2 if s < 0 else (s - x) ** 2 if s > 0 else 0
                   for x, s in zip(inside, step))

    costs = [cost(b) for b in visits]
    assert all(a <= b + 1e-9 for a, b in zip(costs, costs[1:])) and costs[0] == 0


def test_vectors_are_written_once(spark, monkeypatch, tmp_path):
    """No table holds a vector per hash table or per visit."""
    monkeypatch.setattr(A, "fit_probes", lambda *a, **k: 100_000)
    monkeypatch.setattr(A, "Stages", lambda spark: Stages(spark, str(tmp_path)))
    rows = some_rows()
    assert got(table(spark, rows), block=16) == brute(rows, lambda i: i % 20 == 0)
    held = {path.name: spark.read.parquet(str(path)) for path in tmp_path.iterdir()}
    points = held["points"].count()
    assert all(df.count() <= points for df in held.values() if "vector" in df.columns)
    assert "vectors" not in held and {"points", "queries"} <= set(held)
