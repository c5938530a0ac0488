import pytest

from lexorder.operators import counts, names, types
from lexorder.plans import induced
from lexorder.sources.texts import chunk_texts, explode_symbols, pack_symbols
from lexorder.staging import Stages
from tests import model

SHAPES = [{}, {"chunk": 7, "halo": 5}, {"chunk": 16, "halo": 1}, {"chunk": 4, "halo": 4}]


@pytest.fixture(scope="module")
def sample(spark):
    texts = model.sample_texts(1)
    return texts, spark.createDataFrame(list(enumerate(texts)), "id long, text binary")


@pytest.mark.parametrize("shape", SHAPES)
def test_types_stars_and_next_star(sample, shape):
    texts, df = sample
    packed = chunk_texts(df, "id", "text", **shape)
    typed = {(r.text_id, r.pos): r for r in types.classify_suffixes(packed).collect()}
    following = {(r.text_id, r.pos): r.next_star for r in types.next_star(packed).collect()}
    assert len(typed) == sum(map(len, texts))
    for i, text in enumerate(texts):
        minus, (minus_star, plus_star) = model.minus(text), model.stars(text)
        for p, sym in enumerate(text):
            row = typed[i, p]
            assert (row.sym, row.is_minus, row.is_minus_star, row.is_plus_star) == (
                sym, minus[p], p in minus_star, p in plus_star), (text, p)
            assert following[i, p] == min((q for q in minus_star if q > p), default=None)


@pytest.mark.parametrize("shape", SHAPES)
def test_star_substrings_and_names(sample, shape):
    texts, df = sample
    stars = types.star_substrings(chunk_texts(df, "id", "text", **shape)).cache()
    subs = model.grouped(stars.orderBy("text_id", "star_idx").collect(), lambda r: (
        r.star_idx, r.pos, r.end_pos, r.terminal, bytes(r.sub)))
    named = model.grouped(names.name_substrings(stars).orderBy("text_id", "star_idx").collect(),
                          lambda r: r.name)
    count = {r.text_id: r.n_names for r in names.count_names(stars).collect()}
    for i, text in enumerate(texts):
        assert subs.get(i, []) == model.substrings(text)
        assert named.get(i, []) == model.names(text)
        assert count.get(i, 0) == len(set(model.names(text)))


@pytest.mark.parametrize("shape", SHAPES[1:3])
def test_star_substring_order_and_pair_names(sample, shape):
    texts, df = sample
    packed = chunk_texts(df, "id", "text", **shape)
    order = induced.star_substring_order(packed).cache()
    found = model.grouped(order.orderBy("text_id", "star_idx").collect(),
                          lambda r: (r.pos, r.rank, r.tied))
    named = model.grouped(names.name_order(order).orderBy("text_id", "star_idx").collect(),
                          lambda r: r.name)
    by_pairs = model.grouped(names.names_by_pairs(types.star_symbols(packed))
                             .orderBy("text_id", "star_idx").collect(), lambda r: r.name)
    count = {r.text_id: r.n_names for r in names.count_ranks(order).collect()}
    for i, text in enumerate(texts):
        keys = [(sub, not terminal) for _, _, _, terminal, sub in model.substrings(text)]
        assert found.get(i, []) == [
            (p, sum(other < key for other in keys), keys.count(key) > 1)
            for (_, p, _, _, _), key in zip(model.substrings(text), keys)], text
        assert named.get(i, []) == by_pairs.get(i, []) == model.names(text)
        assert count.get(i, 0) == len(set(keys))


def test_no_exchange_carries_a_whole_substring(spark):
    """A substring of 30,000 symbols is sorted by readings of at most a look-ahead."""
    texts = [b"b" + b"a" * 3 + b"b" * 30_000 + b"ca" + b"b" * 30_000 + b"c" + b"ac"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text binary")
    stages = Stages(spark)
    order = induced.star_substring_order(chunk_texts(df, "id", "text", chunk=4096, halo=1024),
                                         stages)
    keys = [(sub, not terminal) for _, _, _, terminal, sub in model.substrings(texts[0])]
    assert [r["rank"] for r in order.orderBy("pos").collect()] == [
        sum(other < key for other in keys) for key in keys]
    heads = spark.read.parquet(f"{stages.folder}/order-heads").collect()
    assert max(len(r["head"]) for r in heads) <= 16


def test_golden_texts(spark):
    texts = list(model.GOLDEN)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text binary")
    packed = chunk_texts(df, "id", "text")
    typed = model.grouped(types.classify_suffixes(packed).orderBy("text_id", "pos").collect(),
                          lambda r: "-" if r.is_minus else "+")
    found = {kind: model.grouped(
        types.star_positions(packed, kind).orderBy("text_id", "pos").collect(), lambda r: r.pos)
        for kind in ("minus", "plus")}
    for i, text in enumerate(texts):
        _, flags, minus_star, plus_star, _ = model.GOLDEN[text]
        assert "".join(typed.get(i, [])) == flags
        assert found["minus"].get(i, []) == minus_star
        assert found["plus"].get(i, []) == plus_star


def test_counts_are_dense_to_the_largest_used_symbol(spark):
    df = spark.createDataFrame([(0, [3, 1, 3, 0, 5]), (1, [2, 1])], "id long, text array<long>")
    typed = types.classify_suffixes(chunk_texts(df, "id", "text", "token"))
    got = {kind: sorted(tuple(r) for r in counts.star_counts(typed, kind).collect())
           for kind in ("minus", "plus")}
    # 3 1 3 0 5: types - + - + -
    assert got["minus"] == [(0, s, c) for s, c in enumerate([0, 0, 0, 1, 0, 1])]
    assert got["plus"] == [(0, 0, 1), (0, 1, 1)]
    assert sorted(tuple(r) for r in counts.plus_counts(typed).collect()) == [(0, 0, 1), (0, 1, 1)]


def test_gaps_of_any_width_are_filled_by_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(counts, "ZEROS", 100)
    df = spark.createDataFrame([(0, [1, 70_000, 3])], "id long, text array<long>")
    typed = types.classify_suffixes(chunk_texts(df, "id", "text", "token"))
    got = {r.sym: r["count"] for r in counts.star_counts(typed, "minus").collect()}
    assert len(got) == 70_001 and got[70_000] == 1 and sum(got.values()) == 1


@pytest.mark.parametrize("shape", SHAPES)
def test_symbol_pairs(sample, shape):
    texts, df = sample
    got = {(r.text_id, r.pos): (r.sym, r.tail_name, r.tail_is_plus) for r in
           types.symbol_pairs(chunk_texts(df, "id", "text", **shape)).collect()}
    for i, text in enumerate(texts):
        minus = model.minus(text)
        for p, sym in enumerate(text):
            tail = (text[p + 1], not minus[p + 1]) if p + 1 < len(text) else (-1, False)
            assert got[i, p] == (sym, *tail)


def test_one_pass_over_the_blocks_for_types(spark):
    df = spark.createDataFrame([(0, "banana" * 20)], "id long, text string")
    texts = chunk_texts(df, "id", "text", chunk=16, halo=4)
    # The directory's own pass is written, and read back as a table: two scans of small rows.
    for made, passes in ((types.with_types(texts), 0), (types.with_directory(texts), 0),
                         (types.classify_suffixes(texts), 1), (types.star_positions(texts), 1),
                         (types.next_star(texts), 1), (types.symbol_pairs(texts), 1)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        scans = sum("_part#" in line for line in plan.splitlines() if "MapInArrow" in line)
        assert plan.count("MapInArrow") == passes + scans and scans <= 2


def test_histogram_and_bucket_starts(spark):
    df = spark.createDataFrame([(0, "banana")], "id long, text string")
    histogram = counts.symbol_histogram(chunk_texts(df, "id", "text", chunk=4, halo=2))
    got = {r.sym: (r["count"], r.start) for r in counts.bucket_starts(histogram).collect()}
    assert got == {ord("a"): (3, 0), ord("b"): (1, 3), ord("n"): (2, 4)}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_symbols_pack_and_explode(spark, chunk):
    tokens = [[5, 300, 70_000, 0, 5, 5], [1], list(range(50))]
    df = spark.createDataFrame(list(enumerate(tokens)), "id long, text array<long>")
    rows = explode_symbols(chunk_texts(df, "id", "text", "token", symbol_bytes=3))
    again = explode_symbols(pack_symbols(rows, 3, chunk=chunk, halo=1))
    got = model.grouped(again.orderBy("text_id", "pos").collect(), lambda r: r.sym)
    assert got == dict(enumerate(tokens))


def test_units(spark):
    df = spark.createDataFrame([(0, "aé€😀"), (1, ""), (2, None)], "id long, text string")
    def symbols(unit):
        rows = explode_symbols(chunk_texts(df, "id", "text", unit)).orderBy("pos").collect()
        return [(r.text_id, r.sym) for r in rows]
    assert symbols("byte") == [(0, b) for b in "aé€😀".encode()]
    assert symbols("char") == [(0, ord(c)) for c in "aé€😀"]


@pytest.mark.parametrize("unit, width, text, kind", [
    ("token", 1, [256], "array<long>"), ("token", 8, [-1], "array<long>"),
    ("token", 2, [None], "array<long>"), ("byte", 3, b"abcd", "binary")])
def test_symbols_that_do_not_fit_are_errors(spark, unit, width, text, kind):
    df = spark.createDataFrame([(0, text)], f"id long, text {kind}")
    with pytest.raises(Exception, match="fit|multiple"):
        chunk_texts(df, "id", "text", unit, symbol_bytes=width).chunks.collect()
