"""Comparing given suffixes: how far they agree, and which one is smaller.

The first symbols of both sides are read from the packed chunks.  Pairs that agree on all of them
go on by prefix hashes: a text has the hash of everything before each chunk, a chunk has marks of
its own prefixes, and two stretches are equal if their differences of prefix hashes are, moved to
one place.  A halving search over the length, one join a step, leaves less than one reading, which
is then read.  At the end all that was taken as equal is compared symbol by symbol, piece by piece;
where hashes deceived, the first different piece tells how far the pair agrees.

No row grows with the text, and a step moves one row per side and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.operators.scans import scan_rows
from lexorder.operators.types import decode
from lexorder.sources.texts import Texts
from lexorder.staging import Stages, tasks_for

LOOK = 256          # symbols that are read at once
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_597_334_677)


def _power(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    """Powers of a base modulo a prime, by squaring."""
    out = np.ones(len(exponent), dtype=np.int64)
    factor, left = base % prime, exponent.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * factor % prime, out)
        factor, left = factor * factor % prime, left >> 1
    return out


def _sums(sym: np.ndarray, beg: int) -> list[np.ndarray]:
    """Hashes of the prefixes (the empty one first) of symbols that start at ``beg``."""
    at = beg + np.arange(len(sym))
    found = []
    for base, prime in zip(BASES, PRIMES):
        # One more than the symbol, so that zeros count; a term is below 2^31, a chunk has fewer.
        terms = (sym.astype(np.uint64) + np.uint64(1)) % np.uint64(prime)
        terms = terms.astype(np.int64) * _power(base, at, prime) % prime
        found.append(np.append(0, np.cumsum(terms) % prime))
    return found


def prefix_hashes(texts: Texts, stages: Stages, look: int) -> DataFrame:
    """``(text_id, chunk_id, h0, h1, marks, ...)``: the chunks with the hashes of what lies before.

    ``marks`` holds the hashes of the chunk's own prefixes at every ``look`` symbols.
    """
    width = texts.width

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
                size = batch.column("len")[row].as_py()
                sums = _sums(decode(raw[:size * width], width), batch.column("beg")[row].as_py())
                marks = np.stack([s[:size:look] for s in sums], 1).astype(">u4").tobytes()
                out.append((int(sums[0][-1]), int(sums[1][-1]), marks))
            own0, own1, marks = map(list, zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), batch.column("chunk_id"), pa.array(own0, pa.int64()),
                 pa.array(own1, pa.int64()), pa.array(marks, pa.binary())],
                names=["text_id", "chunk_id", "own0", "own1", "marks"])

    kind = texts.chunks.schema["text_id"].dataType.simpleString()
    hashed = stages.save(
        texts.chunks.select("text_id", "chunk_id", "beg", "len", "data").mapInArrow(
            own, f"text_id {kind}, chunk_id long, own0 long, own1 long, marks binary"), "hashes")
    before = scan_rows(hashed.select("text_id", "chunk_id", "own0", "own1"), "text_id", "chunk_id",
                       {"h0": "own0", "h1": "own1"}, {}, hashed.count(), stages, "before")
    key = ["text_id", "chunk_id"]
    return (texts.chunks.select(*key, "beg", "data")
            .join(hashed.select(*key, "marks"), key)
            .join(before.select(*key, (F.col("h0") % PRIMES[0]).alias("h0"),
                                (F.col("h1") % PRIMES[1]).alias("h1")), key))


def _hashes_at(wanted: DataFrame, hashes: DataFrame, texts: Texts, look: int,
               tasks: int) -> DataFrame:
    """``(pair, side, at)`` with ``text_id`` to ``(pair, side, g0, g1)``: the hash before ``at``."""
    width = texts.width
    last = F.col("at") - 1                  # in the chunk that has the last symbol
    offset = F.col("at") - F.col("beg")
    mark = F.expr(f"(at - 1 - beg) div {look}")
    read = (wanted.withColumn("chunk_id", F.greatest(F.expr(f"(at - 1) div {texts.chunk}"),
                                                     F.lit(0)))
            .repartition(tasks, "text_id", "chunk_id")
            .join(hashes, ["text_id", "chunk_id"])
            .select("pair", "side", "h0", "h1", (F.col("beg") + mark * look).alias("beg"),
                    F.when(last >= 0, F.substring("marks", (mark * 8 + 1).cast("int"), F.lit(8)))
                    .otherwise(F.lit(b"\0" * 8)).alias("mark"),
                    F.when(last >= 0, F.substring(
                        F.col("data"), (mark * look * width + 1).cast("int"),
                        ((offset - mark * look) * width).cast("int")))
                    .otherwise(F.lit(b"")).alias("rest")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beg = batch.column("beg").to_numpy()
            rest = batch.column("rest").to_pylist()
            sizes = np.array([len(r) // width for r in rest], dtype=np.int64)
            sym = decode(np.frombuffer(b"".join(rest), np.uint8), width)
            row = np.repeat(np.arange(len(rest)), sizes)
            at = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + beg[row]
            marks = np.frombuffer(b"".join(batch.column("mark").to_pylist()), ">u4").reshape(-1, 2)
            out = []
            for i, (base, prime) in enumerate(zip(BASES, PRIMES)):
                terms = (sym.astype(np.uint64) + np.uint64(1)) % np.uint64(prime)
                terms = terms.astype(np.int64) * _power(base, at, prime) % prime
                total = np.zeros(len(rest), dtype=np.int64)
                np.add.at(total, row, terms)
                out.append((total + marks[:, i].astype(np.int64)
                            + batch.column(f"h{i}").to_numpy()) % prime)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pair"), batch.column("side"), pa.array(out[0]), pa.array(out[1])],
                names=["pair", "side", "g0", "g1"])

    return read.mapInArrow(add, "pair long, side int, g0 long, g1 long")


def _both(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per pair with the columns of either side, as ``a_...`` and ``b_...``."""
    return rows.groupBy("pair").agg(*[
        F.max(F.when(F.col("side") == i, F.col(c))).alias(f"{side}_{c}")
        for i, side in enumerate("ab") for c in columns])


def _sides(rows: DataFrame, at: Column, *also: str) -> DataFrame:
    """Two rows for each pair: the text of a side and the position ``at`` from where it starts."""
    return rows.select("pair", *also, at.alias("step"), F.explode(F.array(
        *[F.struct(F.lit(i).alias("side"), F.col(f"text_{s}").alias("text_id"),
                   F.col(f"pos_{s}").alias("start")) for i, s in enumerate("ab")])).alias("s")
    ).select("pair", *also, "s.side", "s.text_id", (F.col("s.start") + F.col("step")).alias("at"))


def _read(wanted: DataFrame, texts: Texts, symbols: int, tasks: int) -> DataFrame:
    """Add ``data``: up to ``symbols`` symbols from ``at`` on; none at the end of the text."""
    begin = (F.col("at") - F.col("beg")) * texts.width + 1
    held = texts.chunks.select("text_id", "chunk_id", "beg", "data")
    return (wanted.withColumn("chunk_id", F.expr(f"at div {texts.chunk}"))
            .repartition(tasks, "text_id", "chunk_id")
            .join(held, ["text_id", "chunk_id"], "left")
            .select(*wanted.columns, F.coalesce(F.substring(
                F.col("data"), begin.cast("int"), F.lit(symbols * texts.width)), F.lit(b""))
                .alias("data")))


def _common(rows: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """``a_data`` and ``b_data`` to ``same``, the symbols they have in common from the start."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("a_data").to_pylist(), batch.column("b_data").to_pylist()):
                size = min(len(a), len(b))
                differs = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
                found.append((int(differs.argmax()) if differs.any() else size) // width)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep],
                                              pa.array(found, pa.int64())],
                                             names=[*keep, "same"])

    return rows.select(*keep, "a_data", "b_data").mapInArrow(count, f"{schema}, same long")


def compare_suffixes(pairs: DataFrame, texts: Texts, stages: Stages | None = None,
                     look: int = LOOK) -> DataFrame:
    """Pairs ``(text_a, pos_a, text_b, pos_b)`` with ``agree`` and ``sign``.

    ``agree`` is the number of symbols that both suffixes start with; ``sign`` is -1, 0 or 1 as
    the first is smaller than, equal to or greater than the second.  A suffix that is a proper
    prefix of the other is smaller; equal suffixes of different texts are equal.  Positions must
    lie in their texts.
    """
    spark = pairs.sparkSession
    stages = stages or Stages(spark)
    look = min(look, texts.halo)
    texts = Texts(stages.save(texts.chunks, "chunks"), texts.width, texts.chunk, texts.halo)
    ends = texts.chunks.filter("last").select("text_id", (F.col("beg") + F.col("len")).alias("end"))
    columns = ["text_a", "pos_a", "text_b", "pos_b"]
    sized = pairs.select(*columns)
    for side in "ab":
        sized = sized.join(ends.select(F.col("text_id").alias(f"text_{side}"),
                                       F.col("end").alias(f"end_{side}")), f"text_{side}")
    rest = F.least(F.col("end_a") - F.col("pos_a"), F.col("end_b") - F.col("pos_b"))
    rows = stages.save(sized.withColumn("most", rest)
                       .withColumn("pair", F.monotonically_increasing_id()), "pairs")
    count = rows.count()
    tasks = tasks_for(spark, count, 2 * count * look * texts.width)

    def read_on(some: DataFrame, known: Column, *also: str) -> DataFrame:
        both = _both(_read(_sides(some, known), texts, look, tasks), ["data"])
        return _common(both.join(some.select("pair", *also), "pair"), texts.width,
                       ["pair", *also])

    first = stages.save(read_on(rows, F.lit(0).cast("long"), "most"), "first")
    agree = first.select("pair", F.col("same").alias("agree"))
    # Alike as far as was read, though both go on.
    open_rows = stages.save(
        rows.join(first.filter((F.col("same") == look) & (F.col("most") > look))
                  .select("pair", F.col("same").alias("known")), "pair"), "open")
    longest = open_rows.agg(F.max("most")).first()[0]
    if longest:
        taken = _longer(open_rows, longest, texts, stages, look, tasks)
        read = read_on(taken, F.col("known"), "known").select(
            "pair", (F.col("known") + F.col("same")).alias("reached"))
        exact = _checked(taken, texts, tasks)
        longer = stages.save(read.join(exact, "pair", "left").select(
            "pair", F.coalesce("differs", "reached").alias("longer")), "longer")
        agree = agree.join(longer, "pair", "left").select(
            "pair", F.coalesce("longer", "agree").alias("agree"))
    agreed = rows.join(agree, "pair")
    # The first symbols that differ decide; a side that ends there is smaller.
    last = _both(_read(_sides(agreed, F.col("agree")), texts, 1, tasks), ["data"])
    sign = (F.when(F.col("a_data") < F.col("b_data"), -1)
            .when(F.col("a_data") > F.col("b_data"), 1).otherwise(0))
    return agreed.join(last, "pair").select(*columns, "agree", sign.alias("sign"))


def _longer(rows: DataFrame, longest: int, texts: Texts, stages: Stages, look: int,
            tasks: int) -> DataFrame:
    """The pairs with ``known`` raised by prefix hashes until less than ``look`` can be missing."""
    hashes = stages.save(prefix_hashes(texts, stages.inner("prefixes"), look), "prefix-hashes")
    start = _both(_hashes_at(_sides(rows, F.lit(0).cast("long")), hashes, texts, look, tasks),
                  ["g0", "g1"]).select(
        "pair", *[F.col(f"{s}_g{i}").alias(f"{s}{i}") for s in "ab" for i in (0, 1)])
    rows = stages.save(rows.join(start, "pair"), "starts")
    step = look
    while look + 2 * step <= longest:
        step *= 2
    while step >= look:
        asked = rows.filter(F.col("known") + step <= F.col("most"))
        there = _both(_hashes_at(_sides(asked, F.col("known") + step), hashes, texts, look, tasks),
                      ["g0", "g1"])
        rows = stages.save(_raised(rows.join(there, "pair", "left"), rows.columns, step),
                           f"step-{step}")
        step //= 2
    return rows.drop("a0", "a1", "b0", "b1")


def _raised(rows: DataFrame, columns: list[str], step: int) -> DataFrame:
    """``known`` raised by ``step`` where the hashes of the stretches up to there are the same."""
    def raise_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = ~batch.column("a_g0").is_null().to_numpy(False)
            move = batch.column("pos_b").to_numpy() - batch.column("pos_a").to_numpy()
            for i, (base, prime) in enumerate(zip(BASES, PRIMES)):
                a, b = ((batch.column(f"{s}_g{i}").fill_null(0).to_numpy()
                         - batch.column(f"{s}{i}").to_numpy()) % prime for s in "ab")
                # The stretch that lies further left is moved to the place of the other.
                a = a * _power(base, np.maximum(move, 0), prime) % prime
                b = b * _power(base, np.maximum(-move, 0), prime) % prime
                same &= a == b
            known = batch.column("known").to_numpy() + step * same
            yield pa.RecordBatch.from_arrays(
                [pa.array(known) if c == "known" else batch.column(c) for c in columns],
                names=columns)

    return rows.mapInArrow(raise_known, rows.select(*columns).schema)


def _checked(rows: DataFrame, texts: Texts, tasks: int) -> DataFrame:
    """``(pair, differs)`` of pairs whose symbols differ before ``known``: where they first do."""
    piece = texts.halo
    pieces = rows.withColumn("from", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("known") - 1, F.lit(piece).cast("long"))))
    size = F.least(F.lit(piece).cast("long"), F.col("known") - F.col("from")) * texts.width
    sides = _read(_sides(pieces, F.col("from"), "known", "from"), texts, piece, tasks)
    shown = sides.withColumn("data", F.substring(F.col("data"), F.lit(1), size.cast("int")))
    both = (shown.groupBy("pair", "from").agg(
        F.max(F.when(F.col("side") == 0, F.col("data"))).alias("a_data"),
        F.max(F.when(F.col("side") == 1, F.col("data"))).alias("b_data"))
        .filter("a_data <> b_data"))
    return (_common(both, texts.width, ["pair", "from"])
            .groupBy("pair").agg(F.min(F.col("from") + F.col("same")).alias("differs")))


def neighbour_agreement(sa: DataFrame, texts: Texts, stages: Stages | None = None,
                        look: int = LOOK) -> DataFrame:
    """``(text_id, rank, pos, agree, sign)``: each suffix compared with the one before it in rank.

    The first of a text has nothing before it: 0 symbols, and it counts as greater.
    """
    spark = sa.sparkSession
    stages = stages or Stages(spark)
    sa = stages.save(sa.select("text_id", "rank", "pos"), "ranks")
    ahead = sa.select("text_id", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("pos_b"))
    pairs = sa.join(ahead, ["text_id", "rank"]).select(
        F.col("text_id").alias("text_a"), F.col("pos").alias("pos_a"),
        F.col("text_id").alias("text_b"), "pos_b")
    found = compare_suffixes(pairs, texts, stages, look).select(
        F.col("text_a").alias("text_id"), F.col("pos_a").alias("pos"), "agree", "sign")
    return sa.join(found, ["text_id", "pos"], "left").select(
        "text_id", "rank", "pos", F.coalesce("agree", F.lit(0)).alias("agree"),
        F.coalesce("sign", F.lit(1)).alias("sign"))
