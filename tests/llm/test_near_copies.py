import random

from pyspark.sql import functions as F

import corpus_pipeline
from lexorder.llm import near_copies as C
from lexorder.llm import simhash

from .data import CLASHES, frame, some_documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def brute_kept(rows):
    """The ids that stay, by comparing all texts with all."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        least.setdefault(g, []).append(r[0])
    return sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()),
                  key=str)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10 ** 9)}"
    return " ".join(words)


def near_copies(seed=6):
    """Pairs on both sides of 0.8, a large group of near copies, and a chain."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for i in range(120):
        text = [word() for _ in range(100)]
        rows += [(2 * i, " ".join(text), "en", "s", 1), (2 * i + 1, edited(rng, text, i % 4), "en", "s", 1)]
    text = [word() for _ in range(150)]
    rows += [(5000 + i, edited(rng, text, rng.randint(1, 4)), "en", "s", 1) for i in range(150)]
    text = [word() for _ in range(100)]
    for i in range(12):
        rows.append((7000 + i, " ".join(text), "en", "s", 1))
        text[8 * i] = f"edit{i}"
    return rows


def test_pipeline_stage_links_five_words_at_point_eight(spark):
    rows = near_copies()
    docs = frame(spark, rows)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    expected = brute_kept(rows)
    assert ids == expected
    # The fingerprints of op2 are another rule.
    assert sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=str) != expected


def test_fingerprints_propose_too(spark, monkeypatch):
    """Without a min-hash in common, what the trees of op2 link is still found."""
    rng = random.Random(10)
    rows = []
    for i in range(30):
        text = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(text), "en", "s", 1), (2 * i + 1, edited(rng, text, 1), "en", "s", 1)]
    own = F.transform(F.sequence(F.lit(1), F.lit(C.BANDS)), lambda i: F.xxhash64("doc_id", i))
    real = C.prints_of
    monkeypatch.setattr(C, "prints_of", lambda text: real(text).withField("keys", own))
    prints = [simhash.fingerprint(r[1].encode(), C.WORDS, 42) for r in rows]
    near = [bin((prints[2 * i] ^ prints[2 * i + 1]) & (1 << 64) - 1).count("1") <= C.REACH
            for i in range(30)]
    kept = sorted(r["doc_id"] for r in C.keep_one(frame(spark, rows)).collect())
    assert sum(near) > 5
    assert kept == sorted([2 * i for i in range(30)] + [2 * i + 1 for i in range(30) if not near[i]])


def test_nulls_copies_and_clashing_names(spark):
    rows = some_documents()
    docs = frame(spark, rows, CLASHES)
    kept = C.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == brute_kept(rows)
    assert C.keep_one(frame(spark, [])).collect() == []


def test_small_parts_leave_no_link_out(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 7)
    rows = near_copies(7)
    rng = random.Random(8)
    # Texts with a passage in common share keys without being similar.
    passage = " ".join(f"p{i}" for i in range(90))
    rows += [(8000 + i, passage + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(40)),
              "en", "s", 1) for i in range(60)]
    rows += [(8200 + i, rows[-1 - i][1] + " end", "en", "s", 1) for i in range(5)]
    ids = sorted((r["doc_id"] for r in C.keep_one(frame(spark, rows)).collect()), key=str)
    assert ids == brute_kept(rows)


def test_large_group_is_done_by_few_comparisons(monkeypatch):
    """A part of near copies compares its first text with all, and hands on a tree."""
    import pyarrow as pa

    rng = random.Random(9)
    text = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [edited(rng, text, 1).encode() for _ in range(400)]
    sets = [C.shingle_set(t) for t in texts]
    asked = []
    real = C._similar_to
    monkeypatch.setattr(C, "_similar_to", lambda one, others: (asked.append(len(others)),
                                                               real(one, others))[1])
    n = list(range(400))
    found = C._links(pa.table({
        "node": n, "root": n, "part": [0] * 400, "size": [len(s) for s in sets],
        "keys": [C.band_keys(s) for s in sets], "text": pa.array(texts, pa.binary())}))
    assert found.num_rows == 399
    assert sum(asked) < 2 * 400
