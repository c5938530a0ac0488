import random

import pytest
from pyspark.sql import functions as F

from lexorder.operators.rank_arrays import RankArrays
from lexorder.plans import doubling as doubling_plan
from lexorder.plans.suffix_array import suffix_array
from lexorder.sources.texts import chunk_texts
from lexorder.staging import Stages
from tests import model


@pytest.mark.parametrize("ids", ["long", "string"])
def test_ranks_are_looked_up_and_changed(spark, ids):
    """Against a dictionary, with texts that end with a chunk, within one and with many."""
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (1, 7, 8, 16, 300, 25_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    packed = chunk_texts(df.withColumn("id", F.col("id").cast(ids)), "id", "t", chunk=8, halo=4)
    known = {(i, p): rng.randrange(len(t)) for i, t in enumerate(texts) for p in range(len(t))}
    cast = int if ids == "long" else str
    rows = spark.createDataFrame([(cast(i), p, r) for (i, p), r in known.items()],
                                 f"text_id {ids}, pos long, rank long")
    arrays = RankArrays(rows, packed, sum(map(len, texts)), Stages(spark), "ranks")
    asked = spark.createDataFrame(
        [(cast(i), p, 0) for i, t in enumerate(texts) for p in range(0, len(t) - 2, 3)],
        f"text_id {ids}, pos long, base long")

    def expect():
        got = arrays.look_up(asked, 3).collect()
        assert len(got) == asked.count()
        for row in got:
            rank = known.get((int(row.text_id), row.pos + 3), -1)
            assert int.from_bytes(row.next, "big") == rank + 1

    expect()
    for share in (5, 0):        # few changes, none
        moved = {at: rng.randrange(25_000) for at in known if share and rng.randrange(100) < share}
        arrays.change(spark.createDataFrame([(cast(i), p, r) for (i, p), r in moved.items()],
                                            f"text_id {ids}, pos long, rank long"))
        known |= moved
        expect()
    assert spark.catalog.tableExists(arrays.table)
    arrays.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexorder_")]


def test_only_open_rows_are_exchanged(spark):
    """The arrays are read in their buckets; one exchange is that of the rows that ask."""
    df = spark.createDataFrame([(0, b"banana" * 50)], "id long, t binary")
    known = spark.createDataFrame([(0, p, p) for p in range(300)],
                                  "text_id long, pos long, rank long")
    packed = chunk_texts(df, "id", "t", chunk=16, halo=4)
    arrays = RankArrays(known, packed, 300, Stages(spark), "ranks")
    looked = arrays.look_up(known.withColumnRenamed("rank", "base").filter("pos < 9"), 6)
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan
    assert "Sort " not in plan and "ShuffledHashJoin" in plan
    arrays.drop()


@pytest.mark.parametrize("options", [{"chunk": 7, "halo": 5}, {"chunk": 16, "halo": 1}, {}])
def test_every_round_by_arrays(spark, monkeypatch, options):
    monkeypatch.setattr(doubling_plan, "PREFIX_BYTES", 1)
    monkeypatch.setattr(doubling_plan, "EXTENSION_BUDGET", 0)
    monkeypatch.setattr(doubling_plan, "BROADCAST_ROWS", 0)
    texts = model.sample_texts(5, count=25)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text binary")
    got = model.grouped(suffix_array(df, "id", "text", method="doubling", **options).orderBy(
        "text_id", "rank").collect(), lambda r: r.pos)
    for i, text in enumerate(texts):
        assert got.get(i, []) == model.suffix_array(text), text
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexorder_")]


def test_symbols_read_between_looks_at_the_arrays(spark, monkeypatch):
    """Changes of a round that read symbols, and of the one before it, are not forgotten."""
    monkeypatch.setattr(doubling_plan, "PREFIX_BYTES", 1)
    monkeypatch.setattr(doubling_plan, "EXTENSION_BUDGET", 2)
    monkeypatch.setattr(doubling_plan, "BROADCAST_ROWS", 0)
    steps = []
    for name in ("change", "look_up"):
        old = getattr(RankArrays, name)
        monkeypatch.setattr(RankArrays, name, lambda self, *rest, name=name, old=old: (
            steps.append(name) or old(self, *rest)))
    read = doubling_plan.read_ahead
    monkeypatch.setattr(doubling_plan, "read_ahead",
                        lambda *rest: steps.append("read") or read(*rest))
    rng = random.Random(6)
    part = bytes(rng.choices(b"ab", k=100))
    text = bytes(rng.choices(b"ab", k=3_000)) + part + bytes(rng.choices(b"abc", k=100)) + part
    df = spark.createDataFrame([(0, text)], "id long, t binary")
    sa = suffix_array(df, "id", "t", method="doubling", chunk=64, halo=32)
    assert [r.pos for r in sa.orderBy("rank").collect()] == model.suffix_array(text)
    first, last = steps.index("look_up"), len(steps) - steps[::-1].index("look_up")
    assert "read" in steps[first:last] and steps[first:last].count("change") >= 2, steps


def test_ranks_are_packed_before_they_are_exchanged(spark, monkeypatch):
    """However the rows lie; what is exchanged is a row per chunk and task, not one per rank."""
    monkeypatch.setattr("lexorder.operators.rank_arrays.BLOBS", 3)
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (300, 40, 16)]
    packed = chunk_texts(spark.createDataFrame(list(enumerate(texts)), "id long, t binary"), "id",
                         "t", chunk=16, halo=4)
    known = [(i, p, rng.randrange(len(t))) for i, t in enumerate(texts) for p in range(len(t))]
    rng.shuffle(known)
    rows = spark.createDataFrame(known, "text_id long, pos long, rank long").coalesce(1)
    plans, write = [], RankArrays._write
    monkeypatch.setattr(RankArrays, "_write", lambda self, arrays: (plans.append(
        arrays._jdf.queryExecution().executedPlan().toString()), write(self, arrays)))
    arrays = RankArrays(rows, packed, 356, Stages(spark), "ranks")
    assert plans[0].count("Exchange ") == 1
    assert plans[0].count("MapInArrow") == 2 and plans[0].index("Exchange ") < plans[0].rindex(
        "MapInArrow")
    held = {(r.text_id, r.chunk_id): r.ranks for r in arrays.arrays().collect()}
    arrays.drop()
    width = len(held[2, 1])
    for i, text in enumerate(texts):
        ranks = b"".join(held[i, c] for c in range(len(text) // 16 + 1))
        got = [int.from_bytes(ranks[k:k + width], "big") for k in range(0, len(ranks), width)]
        assert got == [r + 1 for j, _, r in sorted(known) if j == i] + [0]
