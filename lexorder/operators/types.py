"""Suffix types, star positions and star substrings of packed chunks.

A position is ``minus`` if its suffix is greater than the next one, else ``plus``; the last
position is minus.  A minus position after a plus one is ``minus-star``, a plus position after a
minus one ``plus-star``.  The type of a position is set by the next different symbol, so a chunk
decides its own positions but for a run that leaves its look-ahead; what it needs from the chunks
after it comes from a directory with one small row per chunk of the texts that have several.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.operators.scans import scan_rows
from lexorder.sources.texts import Texts
from lexorder.staging import Stages

SLICE = 1 << 20     # bytes of chunk data handled at once inside a task
STRETCH = 256       # own symbols of a piece: each row made of a piece copies the piece first
UNKNOWN = -1


def decode(raw: np.ndarray, width: int) -> np.ndarray:
    """Packed big-endian symbols as unsigned integers."""
    if width == 1:
        return raw
    if width in (2, 4, 8):
        return raw.view(f">u{width}").astype(np.uint64)
    wide = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    wide[:, 8 - width:] = raw.reshape(-1, width)
    return wide.view(">u8").astype(np.uint64).ravel()


class Block:
    """Chunk rows of one Arrow batch, their symbols laid end to end and typed.

    Arrays over all symbols: ``sym``, ``row`` (chunk row), ``off`` (offset in the chunk), ``own``,
    ``minus`` (1, 0 or ``UNKNOWN``), ``minus_star`` and ``plus_star`` (of own symbols).
    """

    def __init__(self, batch: pa.RecordBatch, width: int, halo: int):
        self.batch, self.width = batch, width
        data = batch.column("data")
        cuts = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1]
        self.raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[cuts[0]:cuts[-1]]
        self.sym = sym = decode(self.raw, width)
        self.start = (cuts[:-1] - cuts[0]) // width      # first symbol of each chunk row
        size = np.diff(cuts) // width
        self.length = batch.column("len").to_numpy()
        self.beg = batch.column("beg").to_numpy()
        self.row = np.repeat(np.arange(len(size)), size)
        self.off = np.arange(len(sym)) - self.start[self.row]
        self.own = self.off < self.length[self.row]

        last = batch.column("last").to_numpy(False)
        ends = last | (size - self.length < halo)        # the text ends with this data
        carried = batch.column("next_minus").cast(pa.int8()).fill_null(UNKNOWN).to_numpy()
        self.edge = edge = self.start + size - 1
        verdict = np.zeros(len(sym), dtype=np.int8)      # type, where the next symbol differs
        differs = np.ones(len(sym), dtype=bool)
        verdict[:-1] = sym[:-1] > sym[1:]
        differs[:-1] = sym[:-1] != sym[1:]
        verdict[edge] = np.where(ends, 1, carried)
        differs[edge] = True
        index = np.where(differs, np.arange(len(sym)), len(sym))
        self.run_stop = np.minimum.accumulate(index[::-1])[::-1]    # last index of the run
        self.minus = verdict[self.run_stop]
        self.leaves = ~ends[self.row] & (self.run_stop == edge[self.row])   # may go on after it

        prev = batch.column("prev")
        before = np.zeros(len(sym), dtype=np.int8)       # type of the symbol before
        before[1:] = self.minus[:-1]
        head = self.start
        known = ~np.asarray(prev.is_null())
        before[head] = self.minus[head] == 1             # position 0 is never a star
        if known.any():
            joined = b"".join(value for value in prev.to_pylist() if value is not None)
            symbol = decode(np.frombuffer(joined, np.uint8), width)
            at = head[known]
            before[at] = np.where(symbol == sym[at], self.minus[at], symbol > sym[at])
        self.before = before
        self.minus_star = self.own & (self.minus == 1) & (before == 0)
        self.plus_star = self.own & (self.minus == 0) & (before == 1)

    def take(self, column: str, rows: np.ndarray) -> pa.Array:
        return self.batch.column(column).take(pa.array(rows))

    def slices(self, beg: np.ndarray, end: np.ndarray) -> pa.Array:
        """The packed symbols ``beg .. end - 1`` (indexes into ``sym``) of each pair, as binary."""
        size = (end - beg) * self.width
        stop = np.cumsum(size)
        cuts = np.concatenate([[0], stop]).astype(np.int32)
        index = np.arange(cuts[-1]) + np.repeat(beg * self.width - cuts[:-1], size)
        return pa.Array.from_buffers(pa.binary(), len(beg),
                                     [None, pa.py_buffer(cuts), pa.py_buffer(self.raw[index])])


def map_blocks(chunks: DataFrame, texts: Texts, columns: dict[str, T.DataType],
               make: Callable[[Block], list]) -> DataFrame:
    """Apply ``make`` to typed blocks of chunk rows; it returns ``text_id`` and ``columns``."""
    width, halo = texts.width, texts.halo
    schema = T.StructType([T.StructField("text_id", chunks.schema["text_id"].dataType)]
                          + [T.StructField(name, kind) for name, kind in columns.items()])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.asarray(batch.column("len").to_numpy(), dtype=np.int64) * width)
            beg = 0
            while beg < batch.num_rows:
                reach = (sizes[beg - 1] if beg else 0) + SLICE
                end = max(beg + 1, int(np.searchsorted(sizes, reach, "right")))
                columns = make(Block(batch.slice(beg, end - beg), width, halo))
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c
                                                  for c in columns], names=names)
                beg = end

    return chunks.mapInArrow(run, schema)


def _single() -> Column:
    return (F.col("chunk_id") == 0) & F.col("last")


UNDECIDED = {"next_minus": "boolean", "next_run_end": "long", "star_base": "long",
             "next_star": "long", "next_plus_star": "long"}


def _without_neighbours(columns: list[str]) -> list[Column]:
    """What a chunk without later or earlier ones is given."""
    return [F.lit(0 if name == "star_base" else None).cast(UNDECIDED[name]).alias(name)
            for name in columns]


def chunk_directory(texts: Texts, stages: Stages) -> DataFrame:
    """A small row per chunk of the texts that have several, from one pass over the blocks.

    ``(text_id, chunk_id)`` with what the chunk must know of the others: the type of the position
    after it (``next_minus``), where the run there ends (``next_run_end``), the minus-stars of
    earlier chunks (``star_base``) and the first star of either kind of the later chunks
    (``next_star``, ``next_plus_star``).  Chunks of a text are spread over the tasks.
    """
    long = texts.chunks.filter(~_single())

    def rows(block: Block) -> list:
        head = block.start
        open_run = block.leaves[head]
        place = block.beg[block.row] + block.off

        def first(star):
            at = np.flatnonzero(star)
            found = np.full(len(head), -1, dtype=np.int64)
            found[block.row[at][::-1]] = place[at][::-1]
            return pa.array(found, mask=found < 0)

        # The first position of a run that leaves the chunk is a star if the run is of its kind.
        start = block.own & block.leaves & (place > 0)
        count = np.bincount(block.row[block.minus_star], minlength=len(head))
        return [block.batch.column("text_id"), block.batch.column("chunk_id"),
                pa.array(block.minus[head] == 1, mask=open_run),
                pa.array(block.beg + block.run_stop[head] - head + 1, mask=open_run),
                pa.array(count), first(block.minus_star), first(block.plus_star),
                first(start & (block.before == 0)), first(start & (block.before == 1))]

    found = stages.save(
        map_blocks(long.select("*", *_without_neighbours(["next_minus", "next_run_end"])), texts,
                   {"chunk_id": T.LongType(), "minus": T.BooleanType(), "run_end": T.LongType(),
                    "stars": T.LongType(), "first_star": T.LongType(),
                    "first_plus": T.LongType(), "open_star": T.LongType(),
                    "open_plus": T.LongType()}, rows), "blocks")
    count = found.count()
    # A chunk that is one run to the end of its look-ahead has the answers of the chunk after it.
    typed = scan_rows(found, "text_id", "chunk_id", {},
                      {"next_minus": "minus", "next_run_end": "run_end"}, count, stages, "runs")
    opened = F.when(F.col("next_minus"), F.col("open_star"))
    opened_plus = F.when(~F.col("next_minus"), F.col("open_plus"))
    starred = typed.select(
        "text_id", "chunk_id", "next_minus", "next_run_end",
        (F.col("stars") + F.when(opened.isNotNull(), 1).otherwise(0)).alias("stars"),
        F.coalesce("first_star", opened).alias("first_star"),
        F.coalesce("first_plus", opened_plus).alias("first_plus"))
    return scan_rows(starred, "text_id", "chunk_id", {"star_base": "stars"},
                     {"next_star": "first_star", "next_plus_star": "first_plus"}, count, stages,
                     "stars")


def _joined(texts: Texts, columns: list[str], stages: Stages | None) -> DataFrame:
    nothing = _without_neighbours(columns)
    if texts.single:
        return texts.chunks.select("*", *nothing)
    key = ["text_id", "chunk_id"]
    stages = (stages or Stages(texts.chunks.sparkSession)).inner(f"directory-{uuid.uuid4().hex}")
    long = texts.chunks.filter(~_single())
    return (texts.chunks.filter(_single()).select("*", *nothing).unionByName(
        long.join(chunk_directory(texts, stages).select(*key, *columns), key)))


def with_types(texts: Texts, stages: Stages | None = None) -> DataFrame:
    """The chunks with what decides a run that leaves them (see ``chunk_directory``)."""
    return _joined(texts, ["next_minus", "next_run_end"], stages)


def with_directory(texts: Texts, stages: Stages | None = None) -> DataFrame:
    """The chunks with all that they must know of the others (see ``chunk_directory``)."""
    return _joined(texts, list(UNDECIDED), stages)


def long_runs(block: Block, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol: what is left of its run, whether that is ``symbols`` or more, and whether
    a stretch of such symbols of one run, or of others, starts here."""
    count = len(block.sym)
    carried = np.asarray(block.batch.column("next_run_end").fill_null(-1))[block.row]
    left = np.where(block.leaves & (carried >= 0),
                    carried - block.beg[block.row] - block.off,
                    block.run_stop - np.arange(count) + 1)
    long = left >= symbols
    new = np.ones(count, dtype=bool)
    new[1:] = (long[1:] != long[:-1]) | (long[1:] & (block.run_stop[1:] != block.run_stop[:-1]))
    return left, long, new


def run_pieces(texts: Texts, symbols: int) -> DataFrame:
    """Own positions of the chunks, cut at runs of one symbol that are ``symbols`` or longer, and
    every ``STRETCH`` symbols.

    ``(text_id, pos, size, data, run_left, run_is_plus)``: ``size`` positions from ``pos``;
    ``data`` reaches ``symbols`` from the last of them.  Inside a long run ``run_left`` tells how
    much of the run is left at ``pos``, and all positions of the piece have ``symbols`` left;
    elsewhere it is null.
    """
    def rows(block: Block) -> list:
        count = len(block.sym)
        left, long, new = long_runs(block, symbols)
        starts = np.flatnonzero(block.own & (new | (block.off % STRETCH == 0)))
        row = block.row[starts]
        own_end = block.start[row] + block.length[row]
        size = np.minimum(np.append(starts[1:], count), own_end) - starts
        data_end = np.append(block.start[1:], count)[row]
        stop = np.minimum(starts + size - 1 + symbols, data_end)
        # In a long run every prefix is the same: one copy of it will do.
        stop = np.where(long[starts], np.minimum(starts + symbols, data_end), stop)
        return [block.take("text_id", row), block.beg[row] + block.off[starts], size,
                block.slices(starts, stop), pa.array(left[starts], mask=~long[starts]),
                block.minus[starts] == 0]

    return map_blocks(with_types(texts), texts, {
        "pos": T.LongType(), "size": T.LongType(), "data": T.BinaryType(),
        "run_left": T.LongType(), "run_is_plus": T.BooleanType()}, rows)


def classify_suffixes(texts: Texts) -> DataFrame:
    """``(text_id, pos, sym, is_minus, is_minus_star, is_plus_star)`` for every position."""
    def rows(block: Block) -> list:
        own = np.flatnonzero(block.own)
        row = block.row[own]
        return [block.take("text_id", row), block.beg[row] + block.off[own],
                block.sym[own].astype(np.int64), block.minus[own] == 1,
                block.minus_star[own], block.plus_star[own]]

    return map_blocks(with_types(texts), texts, {
        "pos": T.LongType(), "sym": T.LongType(), "is_minus": T.BooleanType(),
        "is_minus_star": T.BooleanType(), "is_plus_star": T.BooleanType()}, rows)


def star_positions(texts: Texts, kind: str = "minus") -> DataFrame:
    """``(text_id, pos)`` of the minus-star or plus-star positions."""
    if kind not in ("minus", "plus"):
        raise ValueError("kind must be 'minus' or 'plus'")

    def rows(block: Block) -> list:
        at = np.flatnonzero(block.minus_star if kind == "minus" else block.plus_star)
        row = block.row[at]
        return [block.take("text_id", row), block.beg[row] + block.off[at]]

    return map_blocks(with_types(texts), texts, {"pos": T.LongType()}, rows)


def symbol_pairs(texts: Texts) -> DataFrame:
    """``(text_id, pos, sym, tail_name, tail_is_plus)``: each symbol with the one after it.

    At the end of the text the tail is -1 and not plus.
    """
    def rows(block: Block) -> list:
        own = np.flatnonzero(block.own)
        row = block.row[own]
        ends = own == block.edge[row]       # only the last symbol of a text has none after it
        after = np.where(ends, own, own + 1)
        return [block.take("text_id", row), block.beg[row] + block.off[own],
                block.sym[own].astype(np.int64),
                np.where(ends, -1, block.sym[after].astype(np.int64)),
                ~ends & (block.minus[after] == 0)]

    return map_blocks(with_types(texts), texts, {
        "pos": T.LongType(), "sym": T.LongType(), "tail_name": T.LongType(),
        "tail_is_plus": T.BooleanType()}, rows)


def following_star(block: Block, kind: str = "minus") -> tuple[np.ndarray, np.ndarray]:
    """For each symbol: the index of the next star of its chunk after it, and whether any."""
    far = len(block.sym)
    star = block.minus_star if kind == "minus" else block.plus_star
    at = np.where(star, np.arange(far), far)
    following = np.full(far, far)
    following[:-1] = np.minimum.accumulate(at[::-1])[::-1][1:]
    row_end = block.start[block.row] + block.length[block.row]
    found = following < row_end
    return following, found


def next_star(texts: Texts) -> DataFrame:
    """``(text_id, pos, next_star)``: the next minus-star right of every position, or null."""
    def rows(block: Block) -> list:
        following, found = following_star(block)
        own = np.flatnonzero(block.own)
        row = block.row[own]
        beyond = block.take("next_star", row)
        inside = pa.array(block.beg[row] + following[own] - block.start[row], mask=~found[own])
        return [block.take("text_id", row), block.beg[row] + block.off[own],
                pc.coalesce(inside, beyond)]

    return map_blocks(with_directory(texts), texts,
                      {"pos": T.LongType(), "next_star": T.LongType()}, rows)


def _star_ends(block: Block, halo: int) -> dict[str, np.ndarray]:
    """Of the stars of a block: their symbol, row, index, where they stop, and what data there is.

    ``stop`` is beyond the data where the substring leaves it.
    """
    following, found = following_star(block)
    at = np.flatnonzero(block.minus_star)
    row = block.row[at]
    nth = np.arange(len(at)) - np.searchsorted(row, row)
    beyond = block.take("next_star", row)
    terminal = ~found[at] & np.asarray(beyond.is_null())
    data_end = np.append(block.start[1:], len(block.sym))[row]
    ended = np.asarray(block.take("last", row)) | (
        data_end - block.start[row] - block.length[row] < halo)
    stop = np.where(found[at], following[at] + 1,
                    np.asarray(beyond.fill_null(0)) - block.beg[row] + block.start[row] + 1)
    stop = np.where(terminal, np.where(ended, data_end, data_end + 1), stop)
    return {"at": at, "row": row, "terminal": terminal, "stop": stop, "data_end": data_end,
            "index": block.batch.column("star_base").to_numpy()[row] + nth,
            "end": block.beg[row] + stop - 1 - block.start[row]}


def star_heads(directory: DataFrame, texts: Texts, symbols: int | None = None) -> DataFrame:
    """Minus-stars with the first ``symbols`` (by default ``halo``) symbols of their substring.

    ``(text_id, star_idx, pos, end_pos, terminal, head, more)``; ``more`` tells that the substring
    goes on, and ``end_pos`` of a terminal star may be null then.
    """
    halo, limit = texts.halo, min(symbols or texts.halo, texts.halo)

    def rows(block: Block) -> list:
        star = _star_ends(block, halo)
        at, row, stop = star["at"], star["row"], star["stop"]
        beyond = stop > star["data_end"]
        return [block.take("text_id", row), star["index"], block.beg[row] + block.off[at],
                pa.array(star["end"], mask=star["terminal"] & beyond), star["terminal"],
                block.slices(at, np.minimum(stop, at + limit)), stop - at > limit]

    return map_blocks(directory, texts, {
        "star_idx": T.LongType(), "pos": T.LongType(), "end_pos": T.LongType(),
        "terminal": T.BooleanType(), "head": T.BinaryType(), "more": T.BooleanType()}, rows)


def stars_with_data(directory: DataFrame, texts: Texts) -> DataFrame:
    """Minus-stars with their substring up to the next one, as far as the chunk's data reaches.

    ``(text_id, star_idx, pos, end_pos, terminal, sub)``; ``sub`` is null where the data ends
    before the substring does, and then ``end_pos`` of a terminal star is null too.
    """
    halo = texts.halo

    def rows(block: Block) -> list:
        star = _star_ends(block, halo)
        at, row, stop = star["at"], star["row"], star["stop"]
        fits = stop <= star["data_end"]
        return [block.take("text_id", row), star["index"], block.beg[row] + block.off[at],
                pa.array(star["end"], mask=star["terminal"] & ~fits), star["terminal"],
                pc.if_else(pa.array(fits), block.slices(at, np.where(fits, stop, at)),
                           pa.scalar(None, pa.binary()))]

    return map_blocks(directory, texts, {
        "star_idx": T.LongType(), "pos": T.LongType(), "end_pos": T.LongType(),
        "terminal": T.BooleanType(), "sub": T.BinaryType()}, rows)


def star_symbols(texts: Texts, stages: Stages | None = None) -> DataFrame:
    """``(text_id, star_idx, pos, sym)``: the symbols of every star substring, a row each.

    A star ends one substring and begins the next, so it is in both.
    """
    def rows(block: Block) -> list:
        own = np.flatnonzero(block.own)
        row = block.row[own]
        upto = np.cumsum(block.minus_star[own])
        first = np.searchsorted(row, np.arange(len(block.start)))
        before = np.append(upto, 0)[first] - block.minus_star[own][np.minimum(first, len(own) - 1)]
        index = block.batch.column("star_base").to_numpy()[row] + upto - before[row] - 1
        ends = np.flatnonzero(block.minus_star[own] & (index > 0))
        taken = np.concatenate([np.flatnonzero(index >= 0), ends])
        index = np.concatenate([index[index >= 0], index[ends] - 1])
        return [block.take("text_id", row[taken]), index,
                block.beg[row[taken]] + block.off[own[taken]],
                block.sym[own[taken]].astype(np.int64)]

    return map_blocks(with_directory(texts, stages), texts, {
        "star_idx": T.LongType(), "pos": T.LongType(), "sym": T.LongType()}, rows)


def star_substrings(texts: Texts) -> DataFrame:
    """Every minus-star with its whole substring, up to and with the next star or the text's end.

    ``(text_id, star_idx, pos, end_pos, terminal, sub)``.  A substring that leaves the data of
    its chunk is put together from the chunks it covers.
    """
    chunks, width, chunk = texts.chunks, texts.width, texts.chunk
    directory = with_directory(texts)
    found = stars_with_data(directory, texts)
    columns = found.columns
    several = chunks.filter(~_single())
    parts = stars_with_data(directory.filter(~_single()), texts).filter(F.col("sub").isNull())
    ends = several.filter("last").select("text_id", (F.col("beg") + F.col("len") - 1)
                                         .alias("text_end"))
    begin = F.greatest("pos", "beg") - F.col("beg")
    stop = F.least(F.col("end_pos") + 1, F.col("beg") + F.col("len")) - F.col("beg")
    long = (parts.join(ends, "text_id")
            .withColumn("end_pos", F.coalesce("end_pos", "text_end"))
            .withColumn("chunk_id", F.explode(F.sequence(
                F.expr(f"pos div {chunk}"), F.expr(f"end_pos div {chunk}"))))
            .join(several.select("text_id", "chunk_id", "beg", "len", "data"),
                  ["text_id", "chunk_id"])
            .withColumn("piece", F.substring(
                F.col("data"), (begin * width + 1).cast("int"),
                ((stop - begin) * width).cast("int")))
            .groupBy("text_id", "star_idx", "pos", "end_pos", "terminal")
            .agg(F.expr("listagg(piece) within group (order by chunk_id)").alias("sub")))
    return found.filter(F.col("sub").isNotNull()).unionByName(long.select(*columns))
