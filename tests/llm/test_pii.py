import hashlib
import random
import re
import time

import pytest

from lexorder.llm import pii as P
from lexorder.staging import Stages

from .data import CLASHES, frame, some_documents


def brute_base(text):
    spans = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if max(int(x) for x in m.group().split(".")) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m.group())
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(
        r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return spans


PARTS = ["a.b@c.de", "x@y", "@", "a@b.c_d@x.yz", "é.9@mail.ex", "1.2.3.4", "1.2.3.4.5.6.7.8",
         "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111112", "5472476151044309",
         "+1 (476) 555-6291", "+1", "+12345678", "+1 2 3", "++44 20 7946 0958", " ", "word", "é",
         "(", "-", ".", "a@b@c.d.e", "12-34", "user [at] host.org", "\n", "+4 (((("]


def test_base_spans_against_the_patterns():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) + rng.choice(["", " ", "."])
                       for _ in range(rng.randint(0, 8)))
        got = [(P.KINDS[k], a, b) for k, a, b in sorted(P.base_spans(text))]
        assert got == brute_base(text), text


def test_long_runs_are_scanned_once():
    """A megabyte of digits, dots or signs takes seconds, with the pattern's spans."""
    for made in ("7" * 1_000_000, "1.22." * 100_000, "12.34.56." + "9" * 500_000 + ".1.2",
                 "+" * 500_000, "+1 " * 300_000, "a@" * 20_000, "[at]" * 250_000,
                 "x" * 400_000 + "@", "(" * 500_000):
        began = time.time()
        P.read_text(made)
        assert time.time() - began < 60
    for made in ("7" * 300 + ".1.2.3", "1.2.3." + "4" * 300 + ".5.6.7.8", "1.2.3", "9" * 200):
        assert [(P.KINDS[k], a, b) for k, a, b in sorted(P.base_spans(made))] == brute_base(made)


def test_spelled_signs_in_any_case():
    for sign in ("[at]", " [At] ", "(AT)", "( aT )"):
        text = f"write to user7{sign}host.org now"
        assert (0, 9, len(text) - 4) in P.candidates(text)
    long = "u" * 100 + " [at] " + "h" * 120 + ".org"
    assert (0, 0, len(long)) in P.candidates(long)


def test_contract_and_edges(spark):
    rng = random.Random(4)
    rows = [(r[0], (r[1] or "") + " ".join(rng.choices(PARTS, k=4)) if r[1] else r[1], *r[2:])
            for r in some_documents()]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    got = P.find(frame(spark, rows, CLASHES)).collect()
    assert len(got) == len(rows)
    for r in got:
        matching = False
        for text in texts[r["doc_id"]]:
            base = brute_base(text)
            named = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            if hashlib.sha256(named.encode()).hexdigest() == r["base_sha256"]:
                matching = True
                assert [r[f"n_{k}"] for k in P.KINDS] == [
                    sum(b[0] == k for b in base) for k in P.KINDS]
                spans = r["spans"].split(",") if r["spans"] else []
                assert set(spans) >= {f"{k}:{a}:{b}" for k, a, b in base}
                where = [s.split(":") for s in spans]
                assert where == sorted(where, key=lambda s: (P.KINDS.index(s[0]), int(s[1])))
        assert matching


def test_trees_find_what_the_patterns_miss(spark):
    """Phones without a plus stand like phones with one; order numbers of other forms do not."""
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for i in range(900):
        phone = f"({digits(3)}) 555-{digits(4)}"
        if i % 9 == 0:
            text = f"please call {phone} today"
        elif i % 2:
            text = f"please call +1 {phone} today"
        else:
            text = f"order {digits(8)} was sent {digits(4)}/{digits(4)}"
        rows.append((i, text, "en", "s", 1))
    got = {r["doc_id"]: r for r in P.find(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        spans = got[i]["spans"]
        if text.startswith("order"):
            assert spans == ""


def test_missed_phones_and_spelled_emails_are_added(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for i in range(900):
        phone, name = f"({digits(3)}) 555-{digits(4)}", f"user{digits(3)}"
        if i % 9 == 0:
            text, span = f"please call {phone} today", f"phone:12:{12 + len(phone)}"
            if i % 2:
                text = f"please mail {name} [at] host.org today"
                span = f"email:12:{12 + len(name) + 14}"
        elif i % 3 == 0:
            text, span = f"please mail {name}@host.org today", f"email:12:{12 + len(name) + 9}"
        elif i % 3 == 1:
            text, span = f"please call +1 {phone} today", f"phone:12:{15 + len(phone)}"
        else:
            text, span = f"order {digits(8)} was sent {digits(4)}/{digits(4)}", ""
        rows.append((i, text, "en", "s", span))
    docs = frame(spark, [(*r[:4], 1) for r in rows])
    got = {r["doc_id"]: r["spans"] for r in P.find(docs).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_trees_are_fitted_on_all_candidates(spark, monkeypatch):
    """More candidates than any bound, of which those that are no base spans are few."""
    fitted = []

    class Trees(P.GBTClassifier):
        def fit(self, rows):
            fitted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(P, "GBTClassifier", Trees)
    pool = spark.range(25_000).selectExpr(
        "id AS row", "3 AS kind", "0 AS begin", "9 AS end", "xxhash64(id) AS draw",
        "int(id % 9 > 0) AS label", "array(double(id % 9 > 0), double(id % 7)) AS features")
    P.choose(pool, 3, Stages(spark))
    assert fitted == [pool.filter("pmod(shiftright(draw, 20), 4) <> 3").count()]


@pytest.mark.parametrize("precision", [0.5, 0.8, 0.9, 1.0])
def test_least_score_is_that_of_all_scores(spark, precision):
    rng = random.Random(6)
    scores = [rng.choice((rng.random(), 0.75, 0.75 + 1e-15, 0.9)) for _ in range(500)]
    rows = sorted(((s, min(1.2 * s, 1.0)) for s in scores), reverse=True)
    expected = None
    for s in sorted(set(scores), reverse=True):
        chances = [c for t, c in rows if t > s] + [min(1.2 * s, 1.0)]
        if sum(chances) >= precision * len(chances):
            expected = s
    df = spark.createDataFrame(rows, "score double, chance double")
    assert P.least_score(df, precision) == expected
    assert P.least_score(df.filter("score > 2"), precision) is None


def test_empty_table(spark):
    assert P.find(frame(spark, [])).collect() == []


def test_overlaps(spark):
    rows = spark.createDataFrame([([(-0.9, 5, 9), (-0.8, 0, 6), (-0.7, 0, 5), (-0.6, 9, 12)],)],
                                 "s array<struct<rank: double, begin: int, end: int>>")
    kept = rows.select(P._without_overlaps(rows["s"]).alias("k")).first()["k"]
    assert [(k["begin"], k["end"]) for k in kept] == [(5, 9), (0, 5), (9, 12)]
