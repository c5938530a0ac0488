import random

import pytest

from lexorder.operators import names
from lexorder.plans import levels as plan
from lexorder.sources.texts import chunk_texts
from tests import model


def check(sa, texts):
    got = model.grouped(sa.orderBy("text_id", "rank").collect(), lambda r: r.pos)
    assert {i: model.suffix_array(t) for i, t in enumerate(texts) if t} == got


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(3)
    piece = bytes(rng.choices(b"abc", k=50))
    texts = [b"banana", b"mississippimississippi", piece * 3, b"", b"a" * 40, b"x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    return texts, chunk_texts(df, "id", "t", chunk=64, halo=16)


def test_levels_and_report(spark, packed):
    texts, chunks = packed
    folder = plan.new_folder(spark)
    check(plan.sort_by_levels(chunks, folder), texts)
    rows = {(r.level, r.text_id): r for r in plan.levels(chunks, folder).collect()}
    for i, text in enumerate(texts):
        names, level = list(text), 0
        while names:
            row = rows.pop((level, i))
            named = model.names(tuple(names))
            assert (row.n, row.n_symbols, row.n_stars, row.n_names) == (
                len(names), len(set(names)), len(named), len(set(named)))
            names, level = named if len(set(named)) < len(named) else [], level + 1
    assert not rows
    report = {r.step: r for r in plan.run_report(spark, folder).collect()}
    depth = len(report) // 2
    assert depth > 2 and set(report) == {f"{kind}-{k}" for kind in ("names", "order")
                                         for k in range(depth)}
    assert report["names-0"].symbols == report["order-0"].symbols == sum(map(len, texts))
    assert all(r.seconds > 0 and r.bytes > 0 for r in report.values())


def test_bounded_texts_are_named_by_windows(spark, monkeypatch):
    """No range exchange, which reads its rows twice, where every text is one chunk."""
    texts = ["mississippi" * 9, "banana", "ab" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    monkeypatch.delattr(names, "rank_rows")
    rows = plan.levels(chunk_texts(df, "id", "t"), most=2).filter("level = 0").collect()
    assert {r.text_id: (r.n_stars, r.n_names) for r in rows} == {
        i: (len(named), len(set(named))) for i, t in enumerate(texts)
        for named in [model.names(tuple(t.encode()))]}


def test_a_lost_driver_goes_on(spark, packed, monkeypatch):
    """A run that ends inside a level leaves the levels before it, and none are made again."""
    texts, chunks = packed
    folder = plan.new_folder(spark)
    finish, made = plan.Run.finish, []

    def failing(at):
        def stop(run, step, *args, **found):
            if step == at:
                raise RuntimeError("driver lost")
            made.append(step)
            finish(run, step, *args, **found)
        return stop

    for at in ("names-1", "order-1", None):
        monkeypatch.setattr(plan.Run, "finish", failing(at))
        if at:
            with pytest.raises(RuntimeError):
                plan.sort_by_levels(chunks, folder)
    check(plan.sort_by_levels(chunks, folder), texts)
    assert len(made) == len(set(made))
