import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexorder.operators import counts, positions, types
from lexorder.plans import doubling as doubling_plan
from lexorder.plans import induced as induced_plan
from lexorder.operators import names as names_module
from lexorder.plans.suffix_array import sort_texts, suffix_array
from lexorder.sources.files import read_text_chunks
from lexorder.sources.texts import chunk_texts, explode_symbols, pack_symbols, random_text
from lexorder.staging import Stages
from tests import model


@pytest.fixture(scope="module")
def sample(spark):
    texts = model.sample_texts(2)
    return texts, spark.createDataFrame(list(enumerate(texts)), "id long, text binary")


def orders(sa):
    rows = sa.orderBy("text_id", "rank").collect()
    assert all(a.rank + 1 == b.rank or b.rank == 0 for a, b in zip(rows, rows[1:]))
    return model.grouped(rows, lambda r: r.pos)


def check(sa, texts):
    got = orders(sa)
    for i, text in enumerate(texts):
        assert got.get(i, []) == model.suffix_array(text), text


def test_golden(spark):
    texts = list(model.GOLDEN)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text binary")
    got = orders(suffix_array(df, "id", "text"))
    assert all(got.get(i, []) == model.GOLDEN[text][0] for i, text in enumerate(texts))


@pytest.mark.parametrize("method, options", [
    ("direct", {}), ("direct", {"chunk": 7, "halo": 5}), ("auto", {}), ("doubling", {}),
    ("doubling", {"chunk": 7, "halo": 5}), ("doubling", {"chunk": 40, "halo": 20}),
    ("induced", {}), ("induced", {"chunk": 7, "halo": 5}), ("induced", {"chunk": 50, "halo": 50}),
    ("auto", {"chunk": 16, "halo": 1})])
def test_every_method_gives_the_brute_force_order(sample, method, options):
    texts, df = sample
    check(suffix_array(df, "id", "text", method=method, **options), texts)


@pytest.mark.parametrize("seed", range(3))
def test_random_settings(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(doubling_plan, "PREFIX_BYTES", rng.choice([1, 3, 16]))
    monkeypatch.setattr(doubling_plan, "EXTENSION_BUDGET", rng.choice([0, 1, 16]))
    monkeypatch.setattr(doubling_plan, "BROADCAST_ROWS", rng.choice([0, 100_000]))
    monkeypatch.setattr(induced_plan, "KEY_BYTES", rng.choice([2, 5, 16]))
    monkeypatch.setattr(names_module, "BROADCAST_NAMES", rng.choice([0, 100_000]))
    texts = model.sample_texts(seed + 10, count=25)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text binary")
    chunk = rng.choice([5, 16, 64])
    check(suffix_array(df, "id", "text", method=["doubling", "induced", "induced"][seed],
                       chunk=chunk, halo=rng.randint(1, chunk)), texts)


def test_names_joined_with_salt(spark, monkeypatch):
    """One star substring makes up most of the text, and the name table may not be broadcast."""
    monkeypatch.setattr(names_module, "BROADCAST_NAMES", 0)
    text = b"ab" * 300 + b"acbca" + b"ab" * 100 + b"cab"
    df = spark.createDataFrame([(0, text), (1, b"banana")], "id long, t binary")
    check(suffix_array(df, "id", "t", method="induced"), [text, b"banana"])


@pytest.mark.parametrize("unit, width", [("token", None), ("token", 3), ("char", None)])
@pytest.mark.parametrize("method", ["direct", "doubling", "induced"])
def test_wide_symbols(spark, unit, width, method):
    rng = random.Random(4)
    alphabet = [0, 7, 255, 256, 65_536, 70_000]
    texts = [tuple(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(12)]
    if unit == "char":
        rows = [(i, "".join(map(chr, t))) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "id long, text string")
    else:
        df = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)],
                                   "id long, text array<long>")
    check(suffix_array(df, "id", "text", unit, method, symbol_bytes=width), texts)


def test_string_ids_and_empty_input(spark):
    df = spark.createDataFrame([("x", "banana"), ("y", ""), ("z", None)], "id string, t string")
    assert orders(suffix_array(df, "id", "t")) == {"x": model.GOLDEN[b"banana"][0]}
    nothing = suffix_array(df.filter("false"), "id", "t")
    assert nothing.columns == ["text_id", "rank", "pos"] and nothing.count() == 0


def test_direct_takes_texts_of_any_length(spark):
    text = bytes(random.Random(1).choices(b"ab", k=9_000)) * 2
    df = spark.createDataFrame([(0, text)], "id long, t binary")
    got = [r.pos for r in suffix_array(df, "id", "t", method="direct", chunk=2_048, halo=512)
           .orderBy("rank").collect()]
    assert got == [r.pos for r in suffix_array(df, "id", "t", method="doubling")
                   .orderBy("rank").collect()]


@pytest.mark.parametrize("method", ["auto", "direct", "doubling", "induced"])
def test_null_and_repeated_ids_are_errors(spark, method):
    df = spark.createDataFrame([(0, "banana"), (None, "mississippi")], "id long, t string")
    with pytest.raises(Exception, match="null id"):
        suffix_array(df, "id", "t", method=method)
    df = spark.createDataFrame([(0, "banana"), (1, "x"), (0, "mississippi")], "id long, t string")
    with pytest.raises(ValueError, match="two texts"):
        suffix_array(df, "id", "t", method=method)


@pytest.mark.parametrize("halo", [0, -1, 17])
def test_halo_must_fit(spark, tmp_path, halo):
    df = spark.createDataFrame([(0, "banana" * 10)], "id long, t string")
    with pytest.raises(ValueError, match="halo"):
        suffix_array(df, "id", "t", chunk=16, halo=halo)
    (tmp_path / "t").write_bytes(b"banana")
    with pytest.raises(ValueError, match="halo"):
        read_text_chunks(spark, str(tmp_path / "t"), chunk=16, halo=halo)


def test_induced_stays_induced_with_one_long_run(spark, monkeypatch):
    """Substrings longer than any chunk's data are named by their pieces."""
    monkeypatch.setattr(names_module, "FAN", 3)
    monkeypatch.setattr(doubling_plan, "doubling", None)
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc", k=400)) for _ in range(3)]
    texts += [texts[0][:90] + b"b" * 300 + texts[1][:50] + b"b" * 300 + b"ca" + b"b" * 299 + b"c",
              b"ab" * 150, b"a" + b"b" * 200, b"cb" + bytes(range(200, 20, -1)) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    check(suffix_array(df, "id", "t", method="induced", chunk=32, halo=8), texts)


def test_texts_with_names_of_their_own_leave_the_recursion(spark, monkeypatch):
    """Two texts share substrings; only the third repeats its own."""
    sorted_again = []
    packing = induced_plan.pack_symbols
    monkeypatch.setattr(induced_plan, "pack_symbols", lambda symbols, *rest: (
        sorted_again.append({r.text_id for r in symbols.select("text_id").distinct().collect()})
        or packing(symbols, *rest)))
    texts = [b"banana", b"canana", b"mississippimississippi"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    check(suffix_array(df, "id", "t", method="induced"), texts)
    assert sorted_again[0] == {2}


def test_auto_chooses_for_each_text(spark, monkeypatch):
    from lexorder.plans import suffix_array as plan
    chosen = []
    monkeypatch.setattr(plan, "induced", lambda texts, stages, name: chosen.append(
        {r.text_id for r in texts.chunks.collect()}) or induced_plan.induced(texts, stages, name))
    rng = random.Random(3)
    plain, repeated = bytes(rng.choices(range(65, 90), k=300)), bytes(rng.choices(b"abc", k=60)) * 5
    df = spark.createDataFrame([(0, plain), (1, repeated), (2, b"x")], "id long, t binary")
    check(suffix_array(df, "id", "t"), [plain, repeated, b"x"])
    assert chosen == [{1}]


@pytest.mark.parametrize("shape, star_kind", [
    ({}, "minus"), ({"chunk": 7, "halo": 5}, "minus"), ({"chunk": 16, "halo": 1}, "minus"),
    ({}, "plus"), ({"chunk": 7, "halo": 5}, "plus")])
def test_plus_and_minus_suffixes_induced_from_the_stars(spark, sample, shape, star_kind):
    texts, df = sample
    packed = chunk_texts(df, "id", "text", **shape)
    chosen = [set(model.stars(text)[star_kind == "plus"]) for text in texts]
    star_rows = [(i, rank, p) for i, text in enumerate(texts) for rank, p in enumerate(
        q for q in model.suffix_array(text) if q in chosen[i])]
    stars = spark.createDataFrame(star_rows, "text_id long, rank long, pos long")
    found = {kind: induced_plan.induce(packed, stars, kind, stars=star_kind)
             for kind in ("plus", "minus")}
    for kind, order in found.items():
        got = orders(order)
        for i, text in enumerate(texts):
            minus = model.minus(text)
            assert got.get(i, []) == [p for p in model.suffix_array(text)
                                      if minus[p] == (kind == "minus")], (text, kind)
    if star_kind == "plus":
        check(positions.merge_orders(found["minus"], found["plus"], counts.type_counts(
            types.classify_suffixes(packed)), packed), texts)


def test_wide_symbols_induced_from_plus_stars(spark):
    """The largest symbol of a width is no plus-star, and stands behind all others."""
    rng = random.Random(4)
    texts = [[rng.choice([0, 1, 65534, 65535]) for _ in range(40)] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t array<long>")
    packed = chunk_texts(df, "id", "t", "token", 2, 8, 4)
    stars = spark.createDataFrame(
        [(i, rank, p) for i, text in enumerate(texts) for rank, p in enumerate(
            q for q in model.suffix_array(text) if q in model.stars(text)[1])],
        "text_id long, rank long, pos long")
    minus = orders(induced_plan.induce(packed, stars, "minus", stars="plus"))
    for i, text in enumerate(texts):
        assert minus.get(i, []) == [p for p in model.suffix_array(text) if model.minus(text)[p]]


@pytest.mark.parametrize("method", ["doubling", "induced"])
def test_one_long_text(spark, method):
    """A random text of 200,000 symbols in many chunks, checked by the order rules."""
    rows = random_text(spark, 200_000, 4, seed=7, first=ord("a"))
    texts = pack_symbols(rows, 1, chunk=8_192, halo=1_024)
    sa = sort_texts(texts, method)
    assert sa.count() == 200_000
    assert positions.suffix_order_errors(sa, rows).count() == 0


def test_long_run_is_exact(spark):
    """One symbol repeated: every prefix ties until the very end."""
    df = spark.createDataFrame([(0, b"b" + b"a" * 30_000 + b"b")], "id long, t binary")
    for method in ("doubling", "induced"):
        sa = suffix_array(df, "id", "t", method=method, chunk=2_048, halo=512)
        got = [r.pos for r in sa.orderBy("rank").collect()]
        assert got == list(range(1, 30_001)) + [30_001, 0]


def test_order_errors_are_found(spark):
    df = spark.createDataFrame([(0, "mississippi")], "id long, t string")
    symbols = explode_symbols(chunk_texts(df, "id", "t"))
    sa = suffix_array(df, "id", "t")
    swapped = sa.withColumn("rank", F.when(F.col("rank") == 3, 4).when(F.col("rank") == 4, 3)
                            .otherwise(F.col("rank")))
    doubled = sa.withColumn("rank", F.when(F.col("rank") == 3, 4).otherwise(F.col("rank")))
    assert positions.suffix_order_errors(sa, symbols).count() == 0
    for wrong in (swapped, doubled, sa.filter("rank <> 5")):
        assert positions.suffix_order_errors(wrong, symbols).count() > 0


def test_rows_of_bounded_texts_are_made_where_they_are_ranked(spark, tmp_path):
    """Packed pieces are exchanged, not a row per suffix; the window needs no other exchange."""
    df = spark.createDataFrame([(0, "mississippi" * 50), (1, "banana")], "id long, t string")
    packed = induced_plan.staged(chunk_texts(df, "id", "t"), Stages(spark, str(tmp_path)), "c")
    assert packed.single and packed.total == 556
    rows = doubling_plan.prefixes(packed, 24).withColumn(
        "r", F.rank().over(Window.partitionBy("text_id").orderBy("prefix")))
    assert rows.count() == 556
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_pieces_are_short(spark):
    df = spark.createDataFrame([(0, "mississippi" * 300), (1, "a" * 5000)], "id long, t string")
    texts = chunk_texts(df, "id", "t")
    longest = types.run_pieces(texts, 24).agg(
        F.max("size"), F.max(F.octet_length("data")), F.sum("size")).first()
    assert longest[0] <= types.STRETCH and longest[1] < types.STRETCH + 24
    assert longest[2] == 8300
    assert [r.sym for r in explode_symbols(texts).filter("text_id = 0").orderBy("pos").collect()] \
        == list(b"mississippi" * 300)


@pytest.mark.parametrize("stars", ["minus", "plus"])
def test_induce_ranks_bounded_texts_in_place(spark, monkeypatch, stars):
    """Long texts beside short ones: only the long ones' rows are exchanged by range."""
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (3, 40, 64, 65, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t binary")
    packed = chunk_texts(df, "id", "t", chunk=64, halo=16)
    typed = types.classify_suffixes(packed)
    order = positions.order_within(sort_texts(packed), typed.filter(f"is_{stars}_star"))
    asked = []
    real = doubling_plan.rank_rows
    monkeypatch.setattr(doubling_plan, "rank_rows", lambda rows, *args: (
        asked.append({r[0] for r in rows.select("text_id").distinct().collect()}),
        real(rows, *args))[1])
    for kind in ("minus", "plus"):
        got = model.grouped(induced_plan.induce(packed, order, kind, stars=stars)
                            .orderBy("text_id", "rank").collect(), lambda r: r.pos)
        flags = {(r.text_id, r.pos) for r in typed.filter(f"is_minus = {kind == 'minus'}").collect()}
        expected = {i: [p for p in model.suffix_array(t) if (i, p) in flags]
                    for i, t in enumerate(texts)}
        assert got == {i: order for i, order in expected.items() if order}
    assert asked and set().union(*asked) <= {3, 4}


def test_names_by_pairs_of_texts_of_any_size(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abc", k=n))) for i, n in enumerate((5, 30, 200, 1000))]
    symbols = types.star_symbols(chunk_texts(spark.createDataFrame(rows, "id long, t string"),
                                             "id", "t"))
    ranged, real = [], names_module.rank_rows
    monkeypatch.setattr(names_module, "rank_rows", lambda *args, **more: (
        ranged.append(1), real(*args, **more))[1])
    found = []
    for bound in (1 << 17, 300, 0):
        monkeypatch.setattr(names_module, "BOUNDED", bound)
        found.append(sorted(map(tuple, names_module.names_by_pairs(symbols).collect())))
        assert bool(ranged) == (bound < 1 << 17)
    assert found[0] == found[1] == found[2] and len(found[0]) > 300


def test_order_check_broadcasts_no_symbols(spark, tmp_path):
    """Packed texts are small files, the rows of their symbols are not."""
    spark.range(5).selectExpr("id", "repeat('abc', 50) AS t").write.parquet(str(tmp_path / "t"))
    texts = chunk_texts(spark.read.parquet(str(tmp_path / "t")), "id", "t")
    errors = positions.suffix_order_errors(sort_texts(texts), explode_symbols(texts))
    assert errors.count() == 0
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [text_id" in plan and "BroadcastHashJoin [text_id" not in plan


@pytest.mark.parametrize("shape", [{}, {"chunk": 4, "halo": 2}])
def test_preceding_symbol(spark, shape):
    df = spark.createDataFrame([(0, "mississippi"), (1, "banana")], "id long, t string")
    texts = chunk_texts(df, "id", "t", **shape)
    got = model.grouped(positions.preceding_symbol(sort_texts(texts), texts)
                        .orderBy("text_id", "rank").collect(), lambda r: r.prev_sym)
    for i, text in enumerate([b"mississippi", b"banana"]):
        assert got[i] == [text[p - 1] if p else None for p in model.suffix_array(text)]


def test_random_text(spark):
    got = random_text(spark, 1_000, 4, seed=1, first=ord("a")).collect()
    assert {r.sym for r in got} == set(b"abcd") and {r.pos for r in got} == set(range(1_000))


@pytest.mark.parametrize("at_once", [1, 60, 1 << 18])
def test_short_texts_are_sorted_where_their_chunks_lie(spark, sample, monkeypatch, at_once):
    """No row per suffix is exchanged or written, and texts that are handled together stay apart."""
    monkeypatch.setattr(doubling_plan, "AT_ONCE", at_once)
    monkeypatch.setattr("lexorder.plans.suffix_array.WORTH", 1)
    texts, df = sample
    sa = suffix_array(df, "id", "text")
    plan = sa._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    check(sa, texts)


def test_ties_of_short_texts():
    rng = random.Random(7)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (1, 5, 30, 200)] + [b"a" * 50, b"abc" * 20]
    short = doubling_plan.ShortTexts(np.frombuffer(b"".join(texts), np.uint8),
                                     np.array([len(t) for t in texts]))
    for symbols in (1, 2, 5, 24):
        heads = [Counter(t[i:i + symbols] for i in range(len(t))) for t in texts]
        assert short.ties(symbols).tolist() == [sum(n for n in h.values() if n > 1) for h in heads]


@pytest.mark.parametrize("group, at_once", [(0, 1), (25, 30), (1 << 20, 1), (1 << 20, 1 << 18)])
def test_long_texts_up_to_a_size_are_ranked_from_packed_pieces(spark, sample, monkeypatch, group,
                                                               at_once):
    """In round 0 only texts beyond that size have their rows exchanged by range."""
    texts, df = sample
    monkeypatch.setattr(doubling_plan, "GROUP_SYMBOLS", group)
    monkeypatch.setattr(doubling_plan, "AT_ONCE", at_once)
    asked, real = [], doubling_plan.rank_rows
    monkeypatch.setattr(doubling_plan, "rank_rows", lambda rows, group, key, *rest: (
        asked.append({r[0] for r in rows.select("text_id").distinct().collect()}
                     if key == ["prefix"] else set()), real(rows, group, key, *rest))[1])
    check(suffix_array(df, "id", "text", method="doubling", chunk=7, halo=5), texts)
    assert set().union(*asked) == {i for i, t in enumerate(texts) if len(t) > max(7, group)}


@pytest.mark.parametrize("width, halo", [(1, 40), (1, 1), (2, 7), (5, 6), (8, 9)])
def test_ranks_from_packed_pieces(spark, tmp_path, width, halo):
    """Against prefixes as rows: zero symbols, runs, texts that end within the prefix."""
    rng = random.Random(width)
    texts = [[rng.choice([0, 0, 1, 255]) for _ in range(n)] for n in (60, 100, 333)]
    texts += [[0] * 90, [255] * 90, [1] * 50 + [0] * 60 + [2], [0] * 70 + [3] + [0] * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t array<long>")
    packed = induced_plan.staged(
        chunk_texts(df, "id", "t", "token", width, chunk=50, halo=halo), Stages(
            spark, str(tmp_path)), "c")
    symbols = doubling_plan.first_symbols(packed)
    order = Window.partitionBy("text_id").orderBy("prefix")
    rows = doubling_plan.prefixes(packed, symbols)
    equal = Window.partitionBy("text_id", "prefix")
    expected = rows.select("text_id", "pos", (F.rank().over(order) - 1).cast("long"),
                           F.count("*").over(equal) > 1).collect()
    got = doubling_plan.rank_pieces(packed, symbols, Stages(spark), "r").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_a_written_stage_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        names = [str(disk.getAllFiles().apply(i)) for i in range(disk.getAllFiles().size())]
        return {name for name in names if "shuffle_" in name}

    before = files()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    saved = Stages(spark).save(spark.range(1000).repartition(3, "id"), "rows")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and saved.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled",
                          None) == setting
