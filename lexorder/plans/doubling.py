"""Suffix order by refining the order of ever longer prefixes.

Round 0 ranks every suffix by its first symbols.  A suffix that shares its prefix with no other
is final and never moves again; the rest is refined.  While that is cheap, the next symbols are
read from the packed chunks; then the known ranks further right take their place and the length
compared doubles (Manber and Myers 1993).  A round exchanges the rows still unordered once for
the look-up and once for the ranking.  Texts of one chunk are ranked by window, or sorted
whole where the chunk lies (``chunk_orders``); the rows of longer ones are split by position even
within equal prefixes, so that no repeat makes one task heavy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.functions.ints import pack_big_endian
from lexorder.operators.rank_arrays import RankArrays
from lexorder.operators.ranking import rank_bounded, rank_rows
from lexorder.operators.types import decode, run_pieces
from lexorder.sources.texts import Texts
from lexorder.staging import Stages, tasks_for


@dataclass(frozen=True)
class Packed(Texts):
    """Staged chunks, with what the plans must know of them."""

    total: int = 0      # symbols in all texts


PREFIX_BYTES = 24       # bytes compared in round 0 (at least two symbols)
EXTENSION_BUDGET = 16   # a round may read this many symbols per symbol of all texts
BROADCAST_ROWS = 200_000    # look-ups of up to this many rows are broadcast (counted first)


def prefix_of_piece(width: int, symbols: int) -> Column:
    """The first ``symbols`` symbols of the suffix at offset ``i`` of a piece, fewer at the end.

    Where they are all one symbol, what is left of the run follows as eight bytes, so that a run
    of any length is in order at once: a run that a smaller symbol (or the end) stops sorts
    before one that a greater symbol stops, the shorter first among the former, the longer first
    among the latter.
    """
    i = F.col("i")
    plain = F.substring(F.col("data"), (i * width + 1).cast("int"), F.lit(symbols * width))
    left = F.col("run_left") - i
    order = pack_big_endian(F.when(F.col("run_is_plus"), F.lit(1 << 62) - left).otherwise(left), 8)
    return F.when(F.col("run_left").isNull(), plain).otherwise(F.concat(F.col("data"), order))


def prefixes(texts: Packed, symbols: int) -> DataFrame:
    """``(text_id, pos, prefix)``: the first symbols of every suffix (see ``prefix_of_piece``).

    Texts of one chunk move as packed pieces, and their rows are made where they are ranked.  The
    chunks of longer ones are spread over as many tasks as their rows need.
    """
    tasks = tasks_for(texts.chunks.sparkSession, texts.total)
    if texts.single:
        cut = run_pieces(texts, symbols).repartition(tasks, "text_id")
    else:
        cut = run_pieces(replace(texts, chunks=texts.chunks.repartition(
            tasks, "text_id", "chunk_id")), symbols)
    return (cut
            .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
            .select("text_id", (F.col("pos") + F.col("i")).alias("pos"),
                    prefix_of_piece(texts.width, symbols).alias("prefix")))


def read_size(texts: Packed, symbols: int, count: int) -> int:
    """Bytes of ``count`` rows with ``symbols`` symbols each, and of the chunks they read."""
    chunks = min(texts.total, count * (texts.chunk + texts.halo))
    return (count * symbols + chunks) * texts.width


def read_ahead(rows: DataFrame, texts: Packed, depth: int, symbols: int,
               count: int) -> DataFrame:
    """Add ``next``: up to ``symbols`` symbols of each suffix, starting ``depth`` symbols in.

    Rows that tie have ``depth`` symbols, so the chunk of the last of them exists; it shows the
    symbols after it, or that there are none.  Few rows are sent to the chunks first, so that only
    chunks that are read from move.  Tasks are sized by the bytes that meet in them.
    """
    at = ((F.col("pos") + depth - F.col("beg")) * texts.width + 1).cast("int")
    upcoming = F.substring(F.col("data"), at, F.lit(symbols * texts.width))
    if texts.single:
        # One chunk per text: partitioned by text, the rows are in place for the ranking too.
        wanted, key = rows, ["text_id"]
    else:
        wanted = rows.withColumn("chunk_id", F.expr(f"(pos + {depth - 1}) div {texts.chunk}"))
        key = ["text_id", "chunk_id"]
    held = texts.chunks.select(*key, "beg", "data")
    if count <= BROADCAST_ROWS:
        held = held.join(F.broadcast(wanted.select(*key).distinct()), key, "left_semi")
    tasks = tasks_for(rows.sparkSession, count, read_size(texts, symbols, count))
    return (wanted.repartition(tasks, *key).join(held.repartition(tasks, *key), key)
            .select(*rows.columns, upcoming.alias("next")))


def _rank_ahead(rows: DataFrame, ranks: DataFrame, texts: Packed, depth: int) -> DataFrame:
    """Add ``next``: the known rank of the suffix ``depth`` symbols in, -1 at the text's end.

    Rows that tie have ``depth`` symbols, so that position is in the text or just past its end.
    The rows, which are few, are sent to the ranks, which need no exchange.
    """
    ends = texts.chunks.filter("last").select(
        "text_id", (F.col("beg") + F.col("len")).alias("pos"), F.lit(-1).cast("long")
        .alias("rank"))
    known = ranks.select("text_id", "pos", "rank").unionByName(ends).select(
        "text_id", F.col("pos").alias("_ahead"), F.col("rank").alias("next"))
    wanted = F.broadcast(rows.withColumn("_ahead", F.col("pos") + depth))
    return known.join(wanted, ["text_id", "_ahead"]).select(*rows.columns, "next")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rank(rows: DataFrame, group: list[str], key: list[str], count: int, texts: Packed,
         stages: Stages, name: str, size: int = 0, also: list[str] | None = None,
         placed: bool = False) -> DataFrame:
    """Rank rows in their groups: by window if a group cannot exceed one chunk, else split up.

    ``placed`` tells that rows of texts of one chunk are partitioned by text already.
    """
    tasks = tasks_for(rows.sparkSession, count, size)
    keep = group + ["pos"] + (also or [])
    if texts.single:
        return rank_bounded(rows, group, key, tasks, stages, name, keep, cluster=["text_id"],
                            placed=placed)
    return rank_rows(rows, group, key, ["pos"], tasks, stages, name, keep)


def refine(ranked: DataFrame, depth: int, texts: Packed, stages: Stages, name: str,
           by_rank: bool = True) -> DataFrame:
    """Finish an order in which equal ranks mean equal first ``depth`` symbols.

    ``ranked`` has ``text_id, pos, rank, tied``.  Without ``by_rank`` only symbols are compared,
    as far as two suffixes agree.  Returns the suffix array ``text_id, rank, pos``.

    Ranks that many rows look up are kept packed (see ``RankArrays``), so that a round exchanges
    only rows that are still open and those whose rank has changed since the last look-up.
    """
    final, turn, arrays, changes = [], 0, None, []
    with ExitStack() as cleanup:
        while True:
            final.append(ranked.filter(~F.col("tied")))
            open_rows = ranked.filter("tied").select("text_id", "pos", F.col("rank").alias("base"))
            count = open_rows.count()
            if count == 0:
                return union(final).select("text_id", "rank", "pos")
            turn += 1
            # A text of one chunk can be read to its end; elsewhere the halo is the limit.
            reach = texts.chunk if texts.single else texts.halo
            symbols = min(EXTENSION_BUDGET * texts.total // (count * texts.width), reach)
            if not by_rank:
                symbols = min(depth, reach)
            if symbols >= depth or not by_rank:     # by rank the length compared at least doubles
                rows, size = (read_ahead(open_rows, texts, depth, symbols, count),
                              read_size(texts, symbols, count))
            else:
                symbols, size = depth, 0
                if arrays:
                    for changed in changes:     # in order: a later one holds
                        arrays.change(changed)
                elif count > BROADCAST_ROWS:
                    arrays = RankArrays(union([*final, ranked.filter("tied")]), texts,
                                        texts.total, stages, f"{name}-ranks")
                    cleanup.callback(arrays.drop)
                changes = []
                rows = (arrays.look_up(open_rows, depth) if arrays else _rank_ahead(
                    open_rows, union([*final, ranked.filter("tied")]), texts, depth))
            ranked = rank(rows, ["text_id", "base"], ["next"], count, texts, stages,
                          f"{name}-{turn}", size)
            changes.append(ranked.filter("rank > 0").select(
                "text_id", "pos", (F.col("base") + F.col("rank")).alias("rank")))
            ranked = ranked.select("text_id", "pos", (F.col("base") + F.col("rank")).alias("rank"),
                                   "tied")
            depth += symbols


def first_symbols(texts: Packed) -> int:
    """Symbols that round 0 compares."""
    return min(max(2, PREFIX_BYTES // texts.width), texts.halo + 1)


GROUP_SYMBOLS = 1 << 20     # texts of several chunks, but no longer, are ranked in one task each


def _prefix_words(cut: pa.Table, width: int, symbols: int) -> tuple[np.ndarray, ...]:
    """The suffixes of pieces of whole texts, and what to compare of them.

    ``(piece, pos, columns)``: the piece and the position of each, and the columns, the first
    most significant, that compare as the text and ``prefix_of_piece`` do.
    """
    ids, data = cut.column("text_id"), cut.column("data").combine_chunks()
    new = np.zeros(cut.num_rows, dtype=np.int64)
    new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy()
    text = np.cumsum(new)
    size = cut.column("size").to_numpy()
    left = cut.column("run_left")
    long, left = ~np.asarray(left.is_null()), left.fill_null(0).to_numpy()
    plus = cut.column("run_is_plus").to_numpy()
    held = pc.binary_length(data).to_numpy().astype(np.int64)
    read = symbols * width
    # Behind each piece come zeros, so that no word reaches into the next one.
    room = held + read + 8
    start = np.cumsum(room) - room
    raw = np.zeros(int(room.sum()) + 8, dtype=np.uint64)
    joined = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    raw[np.arange(len(joined)) + np.repeat(start - np.cumsum(held) + held, held)] = joined
    for step in (1, 2, 4):          # eight bytes from every byte on
        raw[:-step] = (raw[:-step] << np.uint64(8 * step)) | raw[step:]
    piece = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    run = long[piece]
    at = start[piece] + np.where(run, 0, i * width)     # a run's pieces have one prefix
    words = [raw[at + 8 * k] for k in range(-(-read // 8))]
    if read % 8:
        words[-1] &= np.uint64((1 << 64) - (1 << (64 - 8 * (read % 8))))
    rest = left[piece] - i
    after = np.where(run, np.where(plus[piece], (1 << 62) - rest, rest),
                     np.minimum(held[piece] // width - i, symbols))
    bits = int(text[-1] + 1).bit_length()
    head = ((text[piece].astype(np.uint64) << np.uint64(64 - bits)) | (words[0] >> np.uint64(bits)))
    return piece, cut.column("pos").to_numpy()[piece] + i, [head, *words, after.astype(np.uint64)]


def _rank_by(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of ``columns``, for each the place of the first equal one, and ties."""
    count = len(columns[0])
    order, first = np.argsort(columns[0]), np.zeros(count, dtype=np.int64)
    slots, key, tied = np.arange(count), None, np.zeros(count, dtype=bool)
    for k, column in enumerate(columns):
        if k:
            some = order[slots]
            again = np.lexsort((column[some], first[slots]))
            order[slots] = some[again]
        key, group = column[order[slots]], first[slots]
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        first[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        same = ~new
        same[:-1] |= ~new[1:]
        slots = slots[same]
        if not len(slots):
            break
    tied[slots] = True
    return order, first, tied


def _whole_texts(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """Tables of whole texts, with ``at_once`` symbols or more, from rows in which texts lie
    together."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += pc.sum(batch.column("size")).as_py() or 0
        if count < at_once:
            continue
        table = pa.Table.from_batches(held)
        ids = table.column("text_id")
        new = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy())
        if len(new):
            cut = int(new[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = pc.sum(table.slice(cut).column("size")).as_py()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def rank_pieces(texts: Packed, symbols: int, stages: Stages, name: str) -> DataFrame:
    """``(text_id, pos, rank, tied)``: every suffix ranked by its prefix, where the packed pieces
    of its text meet.  No text may be longer than ``GROUP_SYMBOLS``."""
    width = texts.width

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _whole_texts(batches, AT_ONCE):
            piece, pos, columns = _prefix_words(cut, width, symbols)
            rows, first, tied = _rank_by(columns)
            ids = cut.column("text_id").combine_chunks().take(pa.array(piece[rows]))
            new = np.zeros(len(rows), dtype=bool)
            new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(False)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            table = pa.table([ids, pos[rows], first - begin, tied],
                             names=["text_id", "pos", "rank", "tied"])
            yield from table.to_batches(max_chunksize=AT_ONCE)

    schema = T.StructType([texts.chunks.schema["text_id"], T.StructField("pos", T.LongType()),
                           T.StructField("rank", T.LongType()),
                           T.StructField("tied", T.BooleanType())])
    tasks = tasks_for(texts.chunks.sparkSession, texts.total)
    return stages.save(run_pieces(texts, symbols).repartition(tasks, "text_id")
                       .sortWithinPartitions("text_id").mapInArrow(order, schema),
                       name, rising=True)


def by_length(texts: Packed) -> tuple[Packed | None, Packed | None]:
    """The texts of several chunks that are no longer than ``GROUP_SYMBOLS``, and the others."""
    longer = texts.chunks.groupBy("text_id").agg(F.sum("len").alias("n")).filter(
        F.col("n") > GROUP_SYMBOLS)
    ids = [row["text_id"] for row in longer.select("text_id").collect()]
    if not ids:
        return texts, None
    among = F.col("text_id").isin(ids)
    total = texts.chunks.filter(among).agg(F.sum("len")).first()[0]
    if total == texts.total:
        return None, texts
    return (replace(texts, chunks=texts.chunks.filter(~among), total=texts.total - total),
            replace(texts, chunks=texts.chunks.filter(among), total=total))


def first_order(texts: Packed, stages: Stages, name: str) -> tuple[DataFrame, int]:
    """Every suffix ranked by its prefix, and the symbols compared.

    Texts of several chunks are split over tasks if they are long; of the others the packed pieces
    meet in a task, which exchanges their symbols about once in place of 24 times.
    """
    symbols = first_symbols(texts)
    if not texts.single:
        bounded, others = by_length(texts)
        parts = [rank_pieces(bounded, symbols, stages, f"{name}-0-packed")] if bounded else []
        if others:
            parts.append(rank(prefixes(others, symbols), ["text_id"], ["prefix"], others.total,
                              others, stages, f"{name}-0").select("text_id", "pos", "rank",
                                                                  "tied"))
        return union(parts), symbols
    return rank(prefixes(texts, symbols), ["text_id"], ["prefix"], texts.total, texts, stages,
                f"{name}-0", placed=True), symbols


AT_ONCE = 1 << 18       # symbols of short texts that are handled together


class ShortTexts:
    """Texts that lie end to end in ``sym``, the number of symbols of each in ``size``."""

    def __init__(self, sym: np.ndarray, size: np.ndarray):
        self.size, self.count = size, len(sym)
        self.row = np.repeat(np.arange(len(size)), size)
        self.start = (np.cumsum(size) - size)[self.row]
        if sym.dtype == np.uint8:       # codes from 1; 0 is the text's end
            self.code = np.cumsum(np.bincount(sym, minlength=256) > 0)[sym]
        else:
            self.code = np.unique(sym, return_inverse=True)[1].astype(np.int64) + 1

    def padded(self, ends: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes with ``ends`` ends after every text, and where the texts' symbols are."""
        laid = np.zeros(self.count + ends * len(self.size), dtype=np.int64)
        at = np.arange(self.count) + ends * self.row
        laid[at] = self.code
        return laid, at

    def order(self) -> np.ndarray:
        """The suffix arrays, text by text, as indexes into all symbols.

        All texts are sorted together, by doubling: the first key holds the text and as many
        symbols as fit 63 bits; only suffixes that tie are sorted again, by the rank of the suffix
        that starts where the compared symbols end.
        """
        count, end = self.count, self.start + self.size[self.row]
        bits, spare = int(self.code.max()).bit_length(), 63 - len(self.size).bit_length()
        depth = max(1, spare // bits)
        laid, at = self.padded(depth)
        key = self.row.astype(np.int64)
        for step in range(depth):
            key = (key << bits) | laid[at + step]
        order = np.argsort(key)
        key, slots = key[order], np.arange(count)
        rank = np.empty(count + 1, dtype=np.int64)
        while True:
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            first = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            rank[order[slots]] = first
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots, first = slots[tied], first[tied]
            if not len(slots):
                return order
            suffix = order[slots]       # those that tie have ``depth`` symbols
            ahead = suffix + depth
            key = first * (count + 1) + np.where(ahead < end[suffix], rank[ahead] + 1, 0)
            again = np.argsort(key)
            key, order[slots] = key[again], suffix[again]
            depth *= 2

    def ties(self, symbols: int) -> np.ndarray:
        """How many suffixes of each text share their first ``symbols`` symbols with another.

        Told by 64 bits of the symbols' hash, which is enough to choose a method.
        """
        laid, at = self.padded(symbols)
        key = np.zeros(self.count, dtype=np.uint64)
        for step in range(symbols):
            key = key * np.uint64(0x9E3779B97F4A7C15) + laid[at + step].astype(np.uint64)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.uint64(len(self.size).bit_length())
        key = np.sort((self.row.astype(np.uint64) << (np.uint64(64) - bits)) | (key >> bits))
        same = np.zeros(self.count, dtype=bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        return np.bincount(self.row[same], minlength=len(self.size))


def map_short(texts: Packed, columns: dict[str, T.DataType],
              make: Callable[[ShortTexts], list]) -> DataFrame:
    """Apply ``make`` to texts of one chunk each, where the chunks lie.

    It returns the index of the text that each row is of, and ``columns``.
    """
    width = texts.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ids = batch.column("data"), batch.column("text_id")
            sizes = pc.binary_length(data).to_numpy().astype(np.int64) // width
            upto, beg = np.cumsum(sizes), 0
            while beg < batch.num_rows:
                reach = (upto[beg - 1] if beg else 0) + AT_ONCE
                end = max(beg + 1, int(np.searchsorted(upto, reach, "right")))
                raw = np.frombuffer(b"".join(data.slice(beg, end - beg).to_pylist()), np.uint8)
                row, *made = make(ShortTexts(decode(raw, width), sizes[beg:end]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(beg + row)), *map(pa.array, made)],
                    names=["text_id", *columns])
                beg = end

    schema = T.StructType([texts.chunks.schema["text_id"]]
                          + [T.StructField(name, kind) for name, kind in columns.items()])
    return texts.chunks.select("text_id", "data").mapInArrow(run, schema)


def chunk_orders(texts: Packed) -> DataFrame:
    """Suffix array ``(text_id, rank, pos)`` of texts of one chunk each, where the chunks lie."""
    def rows(short: ShortTexts) -> list:
        return [short.row, np.arange(short.count) - short.start, short.order() - short.start]

    return map_short(texts, {"rank": T.LongType(), "pos": T.LongType()}, rows)


def chunk_ties(texts: Packed) -> DataFrame:
    """``(text_id, n, ties)`` of texts of one chunk each: suffixes, and those that tie after the
    symbols of round 0."""
    symbols = first_symbols(texts)

    def rows(short: ShortTexts) -> list:
        return [np.arange(len(short.size)), short.size, short.ties(symbols)]

    return map_short(texts, {"n": T.LongType(), "ties": T.LongType()}, rows)


def direct(texts: Packed, stages: Stages, name: str = "direct") -> DataFrame:
    """Suffix array ``(text_id, rank, pos)`` of packed texts, from nothing but their symbols.

    Each round compares as many symbols more as were compared before, at most a look-ahead; a
    text with long repeats takes a round for every look-ahead's worth of them.
    """
    ranked, symbols = first_order(texts, stages, name)
    return refine(ranked, symbols, texts, stages, name, by_rank=False)


def doubling(texts: Packed, stages: Stages, name: str = "doubling") -> DataFrame:
    """Suffix array ``(text_id, rank, pos)`` of packed texts."""
    ranked, symbols = first_order(texts, stages, name)
    return refine(ranked, symbols, texts, stages, name)
