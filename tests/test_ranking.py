import random

import pytest

from lexorder.operators.ranking import rank_bounded, rank_rows
from lexorder.staging import Stages


def expected(rows, what):
    out = {}
    for g, k, t in rows:
        peers = sorted((k2, t2) for g2, k2, t2 in rows if g2 == g)
        smaller = [k2 for k2, _ in peers if k2 < k]
        number = {"rank": len(smaller), "dense": len(set(smaller)),
                  "row": peers.index((k, t))}[what]
        out[t] = (number, sum(k2 == k for k2, _ in peers) > 1)
    return out


@pytest.mark.parametrize("tasks", [1, 6, 17])
@pytest.mark.parametrize("what", ["rank", "dense", "row"])
def test_rank_rows_with_groups_and_ties_over_many_tasks(spark, tasks, what):
    rng = random.Random(tasks)
    rows = [(rng.choice([0, 0, 0, 1, 2]), bytes(rng.choices(b"ab", k=rng.randrange(3))), i)
            for i in range(250)]
    df = spark.createDataFrame(rows, "g long, k binary, t long")
    got = rank_rows(df, ["g"], ["k"], ["t"], tasks, Stages(spark), "x", what=what).collect()
    assert {r.t: (r.rank, r.tied) for r in got} == expected(rows, what)


def test_one_key_for_all_rows_is_split_over_tasks(spark):
    df = spark.range(20_000).selectExpr("0L AS g", "7L AS k", "id AS t")
    stages = Stages(spark)
    ranked = rank_rows(df, ["g"], ["k"], ["t"], 8, stages, "hot")
    assert ranked.filter("rank = 0 AND tied").count() == 20_000
    sizes = [r["count"] for r in spark.read.parquet(f"{stages.folder}/hot")
             .groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 6_000


def test_rows_of_one_key_get_row_numbers_across_tasks(spark):
    df = spark.range(1_000).selectExpr("id % 2 AS g", "7L AS k", "id AS t")
    got = rank_rows(df, ["g"], ["k"], ["t"], 8, Stages(spark), "rows", what="row").collect()
    assert all(r.rank == r.t // 2 for r in got)


def test_rank_bounded_agrees(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), bytes(rng.choices(b"ab", k=rng.randrange(4))), i)
            for i in range(200)]
    df = spark.createDataFrame(rows, "g long, k binary, t long")
    got = rank_bounded(df, ["g"], ["k"], 3, Stages(spark), "x", keep=["t"]).collect()
    assert {r.t: (r.rank, r.tied) for r in got} == expected(rows, "rank")


def test_no_rows(spark):
    df = spark.createDataFrame([], "g long, k long, t long")
    assert rank_rows(df, ["g"], ["k"], ["t"], 4, Stages(spark), "x").count() == 0
