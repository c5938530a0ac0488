"""Every stage of the pipeline on awkward rows, on an empty table, and all of them in a row."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P

from .data import CLASHES, frame, prose, some_documents

ITEM = "the quick brown items of this test are held by some documents word for word"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls, ties, repeated rows and long texts, and a benchmark of one item."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(4)
    rows = some_documents(n=150)
    rows += [(7000 + i, prose(rng, "en", 30) + " " + ITEM + " " + prose(rng, "en", 30), "en",
              "src1", 1) for i in range(5)]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return rows, folder


@pytest.mark.parametrize("number", range(5))
def test_stage(spark, tables, number):
    rows, folder = tables
    name, stage = P.STAGES[number]
    docs = frame(spark, rows, CLASHES)
    out = stage(spark, docs, folder)
    kept = out.collect()
    if number < 4:
        assert out.columns == docs.columns
    texts, held = Counter(r[1] for r in rows), Counter(r["text"] for r in kept)
    if name == "language ID":
        assert None not in held and "" not in held and "12 34 !!" not in held
        assert not held - texts and sum(held.values()) >= 0.9 * len([r for r in rows if r[1]])
    elif name == "near-dedup":
        assert max(held.values()) == 1 and set(filter(None, held)) <= set(texts)
        assert held[rows[0][1]] == 1
    elif name == "benchmark decontamination":
        assert not any(ITEM in (t or "") for t in held)
        assert held == Counter({t: n for t, n in texts.items() if ITEM not in (t or "")})
    elif name == "mixing to target weights":
        words = Counter(r["source"] for r in kept for _ in (r["text"] or "").split())
        assert set(words) <= {r[3] for r in rows}
        size = Counter(r[3] for r in rows for _ in (r[1] or "").split())
        assert all(n <= 3 * size[source] for source, n in words.items())
    else:
        assert held == texts and {r["shard"] for r in kept} <= set(range(8))
        sizes = Counter(r["shard"] for r in kept)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        for shard, n in sizes.items():
            assert sorted(r["slot"] for r in kept if r["shard"] == shard) == list(range(n))


def test_empty_table_passes_every_stage(spark, tables):
    empty = frame(spark, [])
    for number, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, empty, tables[1])
        assert out.collect() == [] and (number == 4 or out.columns == empty.columns)


def test_all_stages(spark, tables):
    rows, folder = tables
    kept = P.run(spark, folder).collect()
    assert kept and not any(ITEM in r["text"] for r in kept)
    known = {r[1] for r in rows}
    whole = [r for r in kept if r["text"] in known]
    assert len(whole) >= len(kept) / 4
    again = P.run(spark, folder).collect()
    key = lambda r: (str(r["doc_id"]), r["text"], r["shard"], r["slot"])
    assert sorted(map(key, kept)) == sorted(map(key, again))
