import random
from fractions import Fraction

from pyspark.sql import functions as F

from lexorder.llm import mixing as M

from .data import CLASHES, frame, rows_of, some_documents


def brute_targets(sizes):
    """{source: size} to targets, resharing what is above three times a size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, full = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        rest = left - sum(full.values())
        over = [s for s in open_ if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / total for s in open_}
        full |= {s: Fraction(3 * sizes[s]) for s in over}


def words(text):
    return len((text or "").encode().split())


def test_contract(spark):
    rows = some_documents(n=200)
    result = M.mix(frame(spark, rows, CLASHES))
    got = result.collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted(
        (str(r[0]), words(r[1])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    wanted = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - float(wanted[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, n in taken.items():
        assert abs(n - wanted[source]) <= max(2 * M.BLOCK, 0.05 * wanted[source])
    again = M.mix(frame(spark, list(reversed(rows))))
    assert rows_of(again.select("doc_id", "taken")) == rows_of(result.select("doc_id", "taken"))


def highest_quotients(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda p: (Fraction(votes[p], 2 * won[p] + 1), -p))
        won[best] += 1
    return won


def test_sainte_lague(spark):
    rng = random.Random(6)
    cases, rows = {}, []
    for g in range(40):
        votes = {p: rng.choice([0, 1, 1, 2, rng.randint(0, 50), rng.randint(0, 10_000)])
                 for p in range(rng.randint(1, 12))}
        seats = rng.randint(0, 80)
        if not sum(votes.values()):
            continue
        cases[g] = highest_quotients(votes, seats)
        rows += [(g, p, v, seats) for p, v in votes.items()]
    df = spark.createDataFrame(rows, "g long, p long, v long, seats long")
    got = M.sainte_lague(df, ["g"], F.col("v"), F.col("seats"), [F.col("p")]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["quota"] == cases[r["g"]][r["p"]], (r, cases[r["g"]])


def test_rows_of_the_mix(spark):
    rows = some_documents(n=200)
    docs = frame(spark, rows, CLASHES)
    mixed = M.mixed_rows(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    known = {}
    for r in rows:
        known.setdefault(r[0], []).append(r[1])
    taken = {}
    for r in out:
        whole = [t for t in known[r["doc_id"]] if t is not None]
        assert any(r["text"] == t or set(r["text"].split()) <= set(t.split()) for t in whole)
        assert r["start"] == "extra start"
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    for source, n in taken.items():
        target = float(brute_targets(sizes)[source])
        assert abs(n - target) <= max(2 * M.BLOCK, 0.05 * target)


def test_empty_and_wordless(spark):
    assert M.mix(frame(spark, [])).collect() == []
    assert M.mixed_rows(frame(spark, [])).collect() == []
    rows = [(1, None, "en", "a", 1), (2, "", "en", None, 1)]
    assert [r["taken"] for r in M.mix(frame(spark, rows)).collect()] == [0, 0]
    assert M.mixed_rows(frame(spark, rows)).collect() == []


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, f"w{i} " * 5, "en", f"s{i % 3}", 1) for i in range(60)] + [
        (7, "the same row " * 4, "en", "s0", 1)] * 30
    got = M.mix(frame(spark, rows)).collect()
    alike = [r["taken"] for r in got if r["size"] == 12]
    assert len(got) == 90 and len(alike) == 30
