import random

from lexorder.llm import decontaminate as D

from .data import CLASHES, frame, prose, rows_of, some_documents


def least_distance(item, text):
    """Edit distance of an item to the nearest substring, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 40)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 60)))
        assert D.best_match(D.peq(item), len(item), text)[0] == least_distance(item, text)


def damaged(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyzw")
        elif kind == 1:
            out.insert(at, rng.choice("xyzw"))
        else:
            del out[at]
    return "".join(out)


def some_tables(seed=5):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice(["en", "de"]), rng.randint(8, 30)).capitalize() + ".")
             for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (23, "Short one"), (24, "Short one"),
              (None, prose(rng, "fr", 12)), (0, prose(rng, "es", 15))]
    docs = [(r[0], r[1]) for r in some_documents()]
    for n, (_, item) in enumerate([i for i in items if i[1] and len(i[1]) > 30]):
        for case, edits in enumerate((0, 1, 4, 9, 30)):
            copy = damaged(rng, item, edits)
            docs.append((9600 + 10 * n + case, f"{prose(rng, 'en', 30)} {copy}\n"
                                                     f"{prose(rng, 'en', 9)}"))
    docs += [(9900, "a short  ONE, here"), (9901, "a short oneness"), (9902, items[0][1].upper()),
             (9903, items[0][1].replace(" ", "\n")), (9904, (items[1][1] + " ") * 20)]
    return [(*d, "en", "s", 1) for d in docs], items


def test_against_brute_force(spark):
    docs, items = some_tables()
    docs = [d for d in docs if not d[1] or len(d[1]) < 5000]
    expected = []
    for d in docs:
        if not d[1]:
            continue
        text = D.normalise(d[1])
        for item_id, raw in items:
            item = D.normalise(raw or "")
            if not item.strip():
                continue
            short = len(item) - 2 < D.SHORTEST
            item = item if short else item.strip()
            budget = 0 if short else int(len(item) * D.RATE)
            distance = least_distance(item, text)
            if distance <= budget:
                expected.append((d[0], item_id, distance))
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.BLOCK_BYTES, 300):       # one block, and many
        got = D.find_contaminated(frame(spark, docs, CLASHES), table, block_bytes=size)
        assert rows_of(got.select("doc_id", "item_id", "distance")) == sorted(expected, key=repr)
    assert len(expected) > 40 and (9900, 23, 0) in expected and (9901, 23, 0) not in expected
    kept = D.without_contaminated(frame(spark, docs, CLASHES), table, block_bytes=300)
    assert kept.columns == frame(spark, docs, CLASHES).columns
    found = {e[0] for e in expected}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(d[0]) for d in docs if d[0] not in found)


def test_empty_tables(spark):
    docs, items = some_tables()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_contaminated(frame(spark, []), table).collect() == []
    assert D.find_contaminated(frame(spark, docs), table.limit(0)).collect() == []
    assert D.without_contaminated(frame(spark, docs), table.limit(0)).count() == len(docs)
