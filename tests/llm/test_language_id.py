import zlib

import numpy as np

from lexorder.llm import language_id as L

from .data import CLASHES, SYLLABLES, frame, some_documents


def test_contract_and_edges(spark):
    rows = some_documents(n=400)
    found = {}
    for r in L.identify(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for doc_id, same in found.items():
        for r in same:
            assert r["held_out"] == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2)
            assert 0 <= r["score"] <= 1
            assert r["lang_pred"] in [*SYLLABLES, "und"]
    for doc_id in (9200, 9201, 9202, 9203):       # null, empty, white space, no letter
        assert found[doc_id][0]["lang_pred"] == "und" and found[doc_id][0]["score"] == 0
    assert found[9204][0]["lang_pred"] == "de"
    assert found[3][0]["lang_pred"] != "und"


def test_held_out_accuracy(spark):
    rows = [r for r in some_documents(seed=2, n=600)[:600] if len(r[1]) > 20]
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in L.identify(frame(spark, rows)).collect() if r["held_out"]]
    assert len(held) > 60
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.95


def test_labels_of_the_other_fold_and_sources_do_not_matter(spark):
    rows = some_documents(seed=3)
    held = lambda r: r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 == 2
    changed = [(r[0], r[1], "xx" if held(r) else r[2], "other", 7) for r in rows]
    a = L.identify(frame(spark, rows)).collect()
    b = L.identify(frame(spark, changed, CLASHES)).collect()
    key = lambda r: (str(r["doc_id"]), r["lang_pred"], round(r["score"], 9))
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_empty_unlabelled_and_one_language(spark):
    assert L.identify(frame(spark, [])).collect() == []
    rows = [(i, "some words", None, None, 1) for i in range(5)]
    assert {r["lang_pred"] for r in L.identify(frame(spark, rows)).collect()} == {"und"}
    rows = [(i, "some words", "en", None, 1) for i in range(5)]
    assert {r["lang_pred"] for r in L.identify(frame(spark, rows)).collect()} == {"en"}


def test_calibration_does_not_follow_a_text_with_most_rows(spark):
    """Copies of a text change no trust, and a rare language gets one of its own."""
    rows = [r for r in some_documents(seed=4, n=500)[:500] if r[2] != "es"]
    rows += [(5000 + i, rows[0][1], rows[0][2], "hot", 1) for i in range(2000)]
    rows += [(9000 + i, f"mañana será otro día número {i}", "es", "s", 1) for i in range(3)]
    plain = [r for r in rows if r[3] != "hot"]
    model = L.fit(frame(spark, plain))
    for bound in (80, 10 ** 9):
        trusts = [L._trust(spark, frame(spark, some).select("lang", "text"), model, bound)
                  for some in (plain, rows)]
        assert np.allclose(*trusts)
        assert np.isfinite(trusts[0]).all() and (trusts[0] > 0).all()


def test_codewords_differ():
    for n in (2, 3, 4, 7, 8, 30):
        code = L.codewords(n)
        apart = (code[:, None] != code[None]).sum(-1) + code.shape[1] * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 5)


def test_long_text_equals_its_pieces(monkeypatch):
    text = "über den wolken und the house " * 50
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(L.BUCKETS, 3)).astype(np.float32)
    weights[0] = 0
    model = L.LanguageModel(["a", "b", "c"], L.codewords(3), weights, np.ones((3, 3)))
    whole = model.margins([text, "x", text])
    monkeypatch.setattr(L, "PIECE", 97)
    # Cuts overlap by an n-gram less one, so all but a few shorter n-grams count once.
    assert np.allclose(whole, model.margins([text, "x", text]), atol=0.1)
