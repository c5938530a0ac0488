import random

import numpy as np
import xxhash

from lexorder.llm import simhash as S
from lexorder.llm.components import components
from lexorder.staging import Stages

from .data import CLASHES, frame, rows_of, some_documents


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = ([b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
                or ([b" ".join(words)] if words else []))
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, reach=2):
    """prints: list of (id, fingerprint); the least id of each row's component."""
    groups = brute_numbers(prints, reach)
    ids = {}
    for g, (doc_id, _) in zip(groups, prints):
        ids.setdefault(g, []).append(doc_id)
    return [min((i for i in ids[g] if i is not None), default=None) for g in groups]


def brute_numbers(prints, reach=2):
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= reach:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_against_brute_force(spark):
    rows = some_documents()
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    expected = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints))),
                      key=repr)
    assert rows_of(S.near_duplicates(frame(spark, rows, CLASHES))) == expected


def near_points(rng, n):
    """Fingerprints in chains and clusters, and by chance."""
    points = [rng.getrandbits(64) for _ in range(n)]
    for p in points[:n // 4]:
        for _ in range(6):
            p ^= 1 << rng.randrange(64)
            p ^= 1 << rng.randrange(64)
            points.append(p)
    return np.unique(np.array(points, dtype=np.uint64))


def brute_groups(points, reach):
    forest = S.Forest(len(points))
    for i in range(len(points)):
        j = np.flatnonzero(np.bitwise_count(points[i] ^ points) <= reach)
        forest.join(np.full(len(j), i), j)
    return forest.root


def test_tree_loses_no_link(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 16)
    for seed in range(5):
        points = near_points(random.Random(seed), 400)
        for reach in (0, 1, 2, 5):
            assert np.array_equal(S.link_groups(points, reach), brute_groups(points, reach))


def test_points_that_nothing_splits(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    points = np.unique(np.array([1 << i for i in range(64)] + [0], dtype=np.uint64))
    assert np.array_equal(S.link_groups(points, 2), brute_groups(points, 2))


def test_shards_hold_every_linked_pair():
    points = near_points(random.Random(9), 600)
    nodes = S.grow(points[::3], 2, 40)
    shards = [set(members.tolist()) for _, members in S.route(points, nodes, 2)]
    assert len(shards) > 4
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None]) <= 2, 1))
    for a, b in near:
        assert any(int(points[a]) in s and int(points[b]) in s for s in shards)


def test_many_shards_through_spark(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 100)
    points = near_points(random.Random(4), 500)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    stages = Stages(spark)
    roots = {r["u"]: r["root"] for r in components(
        S.linked_points(df, 2, stages, shard_points=100), stages).collect()}
    signed = points.view(np.int64)
    least = {}
    groups = brute_groups(points, 2)
    for g, p in zip(groups, signed.tolist()):
        least[g] = min(p, least.get(g, p))
    for g, p in zip(groups, signed.tolist()):
        assert roots.get(p, p) == least[g]


def test_dense_shard_is_cut_into_parts(spark, monkeypatch):
    """Points that nothing splits meet by parts, and the chain through all of them stays whole."""
    rng = random.Random(3)
    monkeypatch.setattr(S, "grow", lambda *a, **k: [])
    cloud = {sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(300)}
    points = np.array(sorted(cloud), dtype=np.uint64)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    stages = Stages(spark)
    links = S.linked_points(df, 2, stages, shard_points=40)
    roots = {r["u"]: r["root"] for r in components(links, stages).collect()}
    groups = brute_groups(points, 2)
    signed = points.view(np.int64)
    least = {}
    for p, g in zip(signed, groups):
        least[g] = min(least.get(g, p), p)
    assert [roots.get(p, p) for p in signed] == [least[g] for g in groups]
    placed = spark.read.parquet(f"{stages.folder}/placed").groupBy("shard").count()
    assert placed.agg({"count": "max"}).first()[0] > 80         # so a shard was cut


def test_components_of_chains_and_hubs(spark):
    links = ([(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)]
             + [(5000, 5001), (5001, 5000), (7, 7)])
    df = spark.createDataFrame(links, "u long, v long")
    roots = dict(map(tuple, components(df, Stages(spark)).collect()))
    assert all(roots[i] == 0 for i in range(1, 61))
    assert all(roots[2000 + i] == 1000 for i in range(50))
    assert roots[5001] == 5000 and 7 in roots and 1000 not in roots
    assert components(df.limit(0), Stages(spark)).count() == 0


def test_keep_one(spark):
    rows = some_documents()
    kept = S.keep_one(frame(spark, rows, CLASHES))
    assert kept.columns == frame(spark, rows, CLASHES).columns
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    # One row of each component, with its least id; two components may share a repeated id.
    least = dict(zip(brute_numbers(prints), brute_components(prints)))
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(
        map(str, least.values()))
    assert S.keep_one(frame(spark, [])).collect() == []
    assert S.near_duplicates(frame(spark, [])).collect() == []
