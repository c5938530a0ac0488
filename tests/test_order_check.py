import random

import pytest

from lexorder.operators.order_check import FALLING, HOLE, MISPLACED, TWICE, order_errors
from lexorder.operators.positions import suffix_order_errors
from lexorder.plans.suffix_array import sort_texts
from lexorder.sources.texts import chunk_texts, explode_symbols
from tests import model


def expected(ranks, symbols):
    """The rules as joins of rows; a null meets nothing and is below all other symbols."""
    def meet(t, p):
        return t is not None and p is not None

    found, suffixes = [], []
    for t, p, v in symbols:
        rows = [r for u, q, r in ranks if meet(t, p) and (u, q) == (t, p)]
        found += [(t, p, MISPLACED)] * (not rows)
        for r in rows:
            found += [(t, p, MISPLACED)] * (r is None or v is None)
            ahead = [-1 if a is None else a for u, q, a in ranks if (u, q) == (t, p + 1)]
            suffixes += [(t, p, r, (v is not None, v or 0, a)) for a in ahead or [-1]]
    here = {(t, p) for t, p, _ in symbols if meet(t, p)}
    found += [(t, p, MISPLACED) for t, p, _ in ranks if (t, p) not in here]
    given = [(t, r) for t, _, r in ranks]
    found += [(t, r, TWICE) for t, r in set(given) if given.count((t, r)) > 1]
    for t, _, r, key in suffixes:
        if r is None:
            continue
        before = [(q, k) for u, q, s, k in suffixes if u == t and s == r - 1]
        found += [(t, q, FALLING) for q, k in before if k >= key]
        found += [(t, r - 1, HOLE)] * (not before and r > 0)
    return found


def damaged(rng, ranks, symbols):
    for _ in range(rng.randrange(4)):
        i, j = rng.randrange(len(ranks)), rng.randrange(len(ranks))
        t, p, r = ranks[i]
        change = rng.randrange(9)
        if change == 0:
            ranks[i], ranks[j] = (t, p, ranks[j][2]), (*ranks[j][:2], r)
        elif change == 1:
            ranks.pop(i)
        elif change == 2:
            ranks.append(ranks[j])
        elif change == 3:
            ranks[i] = (t, p, rng.choice([None, -1, 0, 3, 7, 8, 400]))
        elif change == 4:
            ranks[i] = (t, rng.choice([None, -1, 3, 4, 500]), r)
        elif change == 5:
            ranks[i] = (None, p, r)
        elif change == 6:
            symbols.append(rng.choice(symbols))
        elif change == 7:
            symbols[rng.randrange(len(symbols))] = (t, p, None)
        else:
            symbols.pop(rng.randrange(len(symbols)))


def key(row):
    return tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in row)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("size", [4, 1 << 20])
def test_every_broken_rule_is_told(spark, seed, size):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(b"ab\0", k=n)) for n in (1, 3, 4, 9, 30)]
    ranks, symbols, case = [], [], 0
    for case in range(12):      # a case is a group of texts, in one query
        some = [(f"{case}-{i}", p, r) for i, t in enumerate(texts)
                for r, p in enumerate(model.suffix_array(t))]
        others = [(f"{case}-{i}", p, v) for i, t in enumerate(texts) for p, v in enumerate(t)]
        if case:
            damaged(rng, some, others)
        ranks, symbols = ranks + some, symbols + others
    rng.shuffle(ranks)
    got = order_errors(spark.createDataFrame(ranks, "text_id string, pos long, rank long"),
                       spark.createDataFrame(symbols, "text_id string, pos long, sym long"), size)
    assert got.dtypes == [("text_id", "string"), ("pos", "bigint"), ("error", "string")]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(ranks, symbols), key=key)


def test_rows_are_packed_before_they_are_exchanged(spark):
    """Symbols and ranks are exchanged once each, and once together, all of them packed."""
    df = spark.createDataFrame([(i, "mississippi" * 20) for i in range(5)], "id long, t string")
    texts = chunk_texts(df, "id", "t")
    errors = suffix_order_errors(sort_texts(texts), explode_symbols(texts))
    assert errors.count() == 0
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 3
    assert plan.count("blob") > 3
