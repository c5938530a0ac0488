"""The rules of a suffix array, checked on packed rows.

Symbols and ranks meet by position, suffixes and their successors by rank.  As rows, either takes
several exchanges of every symbol; here rows that lie near one another are packed first, as the
compressed byte planes of their numbers, and each meeting is one exchange of packed rows.  A group
is a stretch of ``BLOCK`` positions or ranks of a text, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20         # positions, or ranks, of a group
HELD_ROWS = 1 << 18     # rows that are packed together
NONE = -(1 << 63)       # in place of a null; below all other numbers, as a null is
MISPLACED, TWICE = "position missing or not in the text", "rank given twice"
FALLING, HOLE = "suffix is not below the next", "rank missing"
ROWS, EDGES, ERRORS = 0, 1, 2
COUNTED, SUFFIX = 1, 2  # flags: a row of the suffix array; a row that has its symbol


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns of integers as compressed planes of the bytes of their differences."""
    planes = [np.diff(c, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def loosened(blob: bytes, rows: int, width: int) -> np.ndarray:
    """The ``width`` columns of ``rows`` integers, as an array."""
    raw = np.frombuffer(pa.decompress(blob, 8 * rows * width, codec="zstd", asbytes=True),
                        np.uint8)
    planes = raw.reshape(width, 8, rows).transpose(0, 2, 1)
    return np.cumsum(np.ascontiguousarray(planes).view("<i8")[:, :, 0], axis=1)


def _all(parts: list[dict] | None, kind: int, width: int) -> np.ndarray:
    found = [loosened(p["blob"], p["rows"], width) for p in parts or () if p["kind"] == kind]
    return np.concatenate(found, axis=1) if found else np.zeros((width, 0), dtype=np.int64)


def blocks(number: np.ndarray, size: int) -> np.ndarray:
    """The block of each position or rank.  -1 and 0 are in one, so that texts begin in one."""
    return (number + 1) // size


def _grouped(text: np.ndarray, columns: list[np.ndarray], size: int) -> Iterator[tuple]:
    """Rows by text and block of their first column: ``(first row, block or None, columns)``."""
    order = np.lexsort((columns[0], text))
    text, columns = text[order], [c[order] for c in columns]
    null, block = columns[0] == NONE, blocks(np.maximum(columns[0], NONE + 1), size)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1]) | (null[1:] != null[:-1])
    starts = np.flatnonzero(new)
    for beg, end in zip(starts, np.append(starts[1:], len(text))):
        yield order[beg], None if null[beg] else int(block[beg]), [c[beg:end] for c in columns]


def _edge(block: int | None, columns: list[np.ndarray], size: int) -> list[np.ndarray] | None:
    """The rows that the block before must know: those with the first number of their block."""
    if block is None:
        return None
    first = columns[0] == block * size - 1
    return [c[first] for c in columns] if first[0] else None


PACKED = [T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()),
          T.StructField("rows", T.LongType()), T.StructField("blob", T.BinaryType())]


def _schema(text_id: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("text_id", text_id.dataType), *PACKED])


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Packed rows ``(row of ids, block, kind, rows, blob)``."""
    at, *columns = zip(*rows) if rows else [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
        names=["text_id", *(f.name for f in PACKED)])


def packed_rows(df: DataFrame, number: str, value: str, edges: bool, size: int) -> DataFrame:
    """Rows ``text_id``, ``number``, ``value`` packed by text and block of the number.

    With ``edges``, those of the first number of a block are sent to the block before it too.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_ROWS:
                yield made(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield made(pa.Table.from_batches(held))

    def made(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("text_id").combine_chunks()
        text = np.zeros(len(ids), dtype=np.int64)
        same = pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).fill_null(False)
        text[1:] = np.cumsum(~same.to_numpy(False))
        columns = [table.column(c).fill_null(NONE).to_numpy() for c in (number, value)]
        out = []
        for row, block, some in _grouped(text, columns, size):
            out.append((row, block, ROWS, len(some[0]), squeezed(some)))
            if edges and (edge := _edge(block, some, size)):
                out.append((row, block - 1, EDGES, len(edge[0]), squeezed(edge)))
        return _batch(ids, out)

    return df.select("text_id", F.col(number).cast("long"), F.col(value).cast("long")).mapInArrow(
        pack, _schema(df.schema["text_id"]))


def _by_group(packed: DataFrame, name: str) -> DataFrame:
    return packed.groupBy("text_id", "block").agg(
        F.collect_list(F.struct("kind", "rows", "blob")).alias(name))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a row and a member of its range ``low .. high - 1``."""
    size = high - low
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def between(numbers: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``numbers`` hold each wanted one."""
    return np.searchsorted(numbers, wanted), np.searchsorted(numbers, wanted, "right")


def sorted_by_first(columns: np.ndarray) -> np.ndarray:
    return columns[:, np.argsort(columns[0], kind="stable")]


def suffixes_of(symbols: np.ndarray, ranks: np.ndarray, beyond: np.ndarray) -> tuple:
    """The suffixes of a block and the positions that are wrong.

    ``symbols`` are ``pos, sym``, ``ranks`` are ``pos, rank``, and ``beyond`` those of the first
    position after the block.  A suffix is ``rank, pos, sym, ahead, flags``; ``ahead`` is the rank
    of the suffix one symbol on, -1 if there is none.  Every row of ``ranks`` is counted once.
    """
    symbols, ranks = sorted_by_first(symbols), sorted_by_first(ranks)
    low, high = between(ranks[0], symbols[0])
    wrong = [symbols[0][low == high]]
    low, high = between(symbols[0], ranks[0])
    none = low == high
    wrong.append(ranks[0][none])
    alone = np.stack([ranks[1], ranks[0], *np.zeros((2, len(none)), np.int64),
                      np.full(len(none), COUNTED)])[:, none]
    row, symbol = spread(low, high)
    (pos, rank), sym = ranks[:, row], symbols[1][symbol]
    wrong.append(pos[(rank == NONE) | (sym == NONE)])
    after = sorted_by_first(np.concatenate([ranks, beyond], axis=1))
    low, high = between(after[0], pos + 1)
    ends = low == high
    pair, at = spread(low, high + ends)
    values = np.append(after[1], NONE)
    ahead = np.where(ends[pair], NONE, values[at])
    ahead = np.where(ahead == NONE, -1, ahead)
    flags = np.full(len(pair), SUFFIX)
    flags[np.flatnonzero(np.diff(row[pair], prepend=-1))] |= COUNTED
    found = np.stack([rank[pair], pos[pair], sym[pair], ahead, flags])
    return np.concatenate([found, alone], axis=1), np.concatenate(wrong)


def errors_of(rows: np.ndarray, beyond: np.ndarray, size: int) -> list[tuple[np.ndarray, str]]:
    """The positions, or ranks, at which a block of ranks breaks a rule, and the rule.

    ``rows`` are suffixes (see ``suffixes_of``), ``beyond`` those of the next block's first rank.
    """
    ranks, times = np.unique(rows[0][rows[4] & COUNTED > 0], return_counts=True)
    found = [(ranks[times > 1], TWICE)]
    rows = sorted_by_first(rows[:, (rows[4] & SUFFIX > 0) & (rows[0] != NONE)])
    inside = rows[:, (rows[0] + 1) % size != 0]
    after = np.concatenate([inside, beyond[:, beyond[4] & SUFFIX > 0]], axis=1)
    low, high = between(rows[0], after[0] - 1)
    hole = (low == high) & (after[0] > 0)
    pair, at = spread(low, high)
    (_, pos, sym, ahead, _), (_, _, next_sym, next_ahead, _) = rows[:, at], after[:, pair]
    falling = (sym > next_sym) | (sym == next_sym) & (ahead >= next_ahead)
    return [*found, (pos[falling], FALLING), (after[0][hole] - 1, HOLE)]


def order_errors(sa: DataFrame, symbols: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(text_id, pos, error)`` (see ``positions.suffix_order_errors``)."""
    met = (_by_group(packed_rows(symbols, "pos", "sym", False, size), "symbols").join(
        _by_group(packed_rows(sa, "pos", "rank", True, size), "ranks").hint("merge"),
        ["text_id", "block"], "full_outer"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = batch.column("text_id"), batch.column("block")
            for row in range(batch.num_rows):
                ranks = batch.column("ranks")[row].as_py()
                rows, wrong = suffixes_of(_all(batch.column("symbols")[row].as_py(), ROWS, 2),
                                          _all(ranks, ROWS, 2), _all(ranks, EDGES, 2))
                out = []
                if len(wrong):
                    out.append((row, block[row].as_py(), ERRORS, len(wrong), squeezed([wrong])))
                if rows.shape[1]:
                    text = np.zeros(rows.shape[1], dtype=np.int64)
                    for _, at, some in _grouped(text, list(rows), size):
                        out.append((row, at, ROWS, len(some[0]), squeezed(some)))
                        if edge := _edge(at, some, size):
                            out.append((row, at - 1, EDGES, len(edge[0]), squeezed(edge)))
                if out:
                    yield _batch(ids, out)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("text_id")
            for row in range(batch.num_rows):
                parts = batch.column("parts")[row].as_py()
                for at, error in [(_all(parts, ERRORS, 1)[0], MISPLACED),
                                  *errors_of(_all(parts, ROWS, 5), _all(parts, EDGES, 5), size)]:
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([row] * len(at))),
                             pa.array(at, mask=at == NONE), pa.array([error] * len(at))],
                            names=["text_id", "pos", "error"])

    schema = T.StructType([T.StructField("text_id", met.schema["text_id"].dataType),
                           T.StructField("pos", T.LongType()),
                           T.StructField("error", T.StringType())])
    ranked = met.mapInArrow(suffixes, _schema(met.schema["text_id"]))
    return _by_group(ranked, "parts").mapInArrow(errors, schema)
