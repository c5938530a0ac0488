from collections import Counter

from lexorder.llm import line_dedup as D

from .data import CLASHES, frame, rows_of


def brute(rows):
    """The text each (id, text) keeps; rows that repeat both are one document."""
    import xxhash
    def order(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42) if r[1] is not None else 42
        return (r[0] is None, r[0] or 0, h - (1 << 64) if h >= 1 << 63 else h)
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=order):
        if text is None:
            out[doc_id, text] = (None, 0, 0)
            continue
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if not any(window):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out[doc_id, text] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return sorted(((r[0], *out[r[0], r[1]]) for r in rows), key=repr)


ROWS = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "a\nb\nc\na\nb\nc"),
        (5, "a\nb\nc\nd\ne"), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, "short"), (9, None), (10, ""),
        (None, "a\nb\nc\nz"), (2, "x\na\nb\nc\ny"), (2, "q\na\nb\nc\ny"), (11, "p\np\np\np\np"),
        (12, "\n".join(f"line {i % 50}" for i in range(3000))), (13, "d\ne\nd\ne\nd\ne\nd"),
        *[(100 + i, f"head {i}\nfree\nto\nuse\ntail {i}") for i in range(60)]]


def test_against_brute_force(spark):
    rows = [(i, t, "en", "s", 1) for i, t in ROWS]
    expected = brute(ROWS)
    assert rows_of(D.remove_repeats(frame(spark, rows, CLASHES))) == expected
    assert Counter(e[3] for e in expected)[3] >= 59       # all but the first lose the passage


def test_empty_table(spark):
    assert D.remove_repeats(frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = D.remove_repeats(frame(spark, [(1, "a", "en", "s", 1)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
