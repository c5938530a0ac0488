import random

from lexorder.operators import scans, types
from lexorder.operators.scans import scan_rows
from lexorder.sources.texts import pack_symbols, random_text
from lexorder.staging import Stages


def test_sums_and_next_values_across_partitions(spark, monkeypatch):
    """Groups of one row, of many partitions, and with nothing known."""
    monkeypatch.setattr(scans, "tasks_for", lambda *_: 23)
    monkeypatch.setattr(scans, "ONE_TASK", 0)
    rng = random.Random(1)
    rows = []
    for group in range(30):
        for at in range(rng.choice([1, 2, 5, 200])):
            value = rng.randint(0, 99) if rng.random() < 0.05 and group % 3 else None
            rows.append((group, at, rng.randint(-3, 9), value))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v long, w long")
    got = {(r.g, r.o): (r.before, r.later) for r in scan_rows(
        df, "g", "o", {"before": "v"}, {"later": "w"}, len(rows), Stages(spark), "x").collect()}
    for g, o, _, _ in rows:
        own = sorted(r for r in rows if r[0] == g)
        later = [r[3] for r in own if r[1] > o and r[3] is not None]
        assert got[g, o] == (sum(r[2] for r in own if r[1] < o), later[0] if later else None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "g long, o long, v long")
    assert scan_rows(df, "g", "o", {"s": "v"}, {"n": "v"}, 0, Stages(spark), "x").collect() == []


def test_one_text_of_many_chunks_is_spread(spark, monkeypatch):
    """The directory of one text goes to many tasks, none of which has more than its share."""
    monkeypatch.setattr(scans, "ONE_TASK", 1_000)
    texts = pack_symbols(random_text(spark, 100_000, 3, seed=5), 1, chunk=4, halo=2)
    stages = Stages(spark)
    directory = types.chunk_directory(texts, stages)
    plan = directory._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert directory.count() == 25_000
    shares = [r["count"] for r in spark.read.parquet(f"{stages.folder}/stars")
              .groupBy("_part").count().collect()]
    assert len(shares) >= 4 and max(shares) < 2 * 25_000 / len(shares)
