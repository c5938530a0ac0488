"""Running sums and next known values over groups of any size.

``Window.partitionBy(group)`` is one task per group, and one text may have most of the rows.
``scan_rows`` range partitions the rows on group and order, so that a group spreads over tasks;
each task scans its own rows; and of each partition one row goes to the driver, to learn what the
partitions before it add to its first group and what those after it bring to its last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.staging import Stages, tasks_for


ONE_TASK = 200_000      # small rows that a single task scans


def _starts(table: pa.Table, group: str) -> np.ndarray:
    """Whether a row is the first of its group among the sorted rows."""
    new = np.ones(table.num_rows, dtype=bool)
    column = table.column(group)
    new[1:] = pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
    return new


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows before in the same group; ``first`` is the index at which it starts."""
    before = np.cumsum(values) - values
    return before - before[first]


def _next_index(known: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the next row with a known value after each row in its group, -1 if none."""
    count = len(known)
    at = np.append(np.where(known, np.arange(count), count), count)
    following = np.minimum.accumulate(at[::-1])[::-1][1:]
    return np.where(following <= last, following, -1)


def scan_rows(df: DataFrame, group: str, order: str, sums: dict[str, str],
              nexts: dict[str, str], count: int, stages: Stages, name: str) -> DataFrame:
    """Add sums over the rows before, and the next known values, within each group.

    ``sums`` maps new columns to integer columns without nulls: the sum over the group's earlier
    rows, 0 for the first.  ``nexts`` maps new columns to columns: the nearest value that is not
    null among the group's later rows, or null.  ``count`` is the number of rows, which are small;
    group and order tell them apart.  Few rows are scanned in one task, with no job of their own.
    """
    shown = df.columns
    kinds = ([T.StructField(new, T.LongType()) for new in sums]
             + [T.StructField(new, df.schema[old].dataType) for new, old in nexts.items()])
    schema = T.StructType([*df.schema, *kinds, T.StructField("_part", T.IntegerType()),
                           T.StructField("_first", T.BooleanType()),
                           T.StructField("_last", T.BooleanType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One task's rows: at most a few million small ones.
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        count = table.num_rows
        new = _starts(table, group)
        bounds = np.append(np.flatnonzero(new), count)
        number = np.cumsum(new) - 1
        first, last = bounds[number], bounds[number + 1] - 1
        columns = [table.column(c) for c in shown]
        for old in sums.values():
            columns.append(pa.array(_summed(table.column(old).to_numpy().astype(np.int64), first)))
        for old in nexts.values():
            column = table.column(old)
            at = _next_index(~column.is_null().to_numpy(), last)
            columns.append(column.take(pa.array(at, mask=at < 0)))
        columns += [pa.array(np.full(count, TaskContext.get().partitionId(), np.int32)),
                    pa.array(number == 0), pa.array(number == number[-1])]
        yield from pa.table(columns, names=schema.names).to_batches(max_chunksize=10_000)

    if count <= ONE_TASK:
        return (df.repartition(1).sortWithinPartitions(group, order).mapInArrow(scan, schema)
                .select(*shown, *sums, *nexts))
    scanned = stages.save(
        df.repartitionByRange(tasks_for(df.sparkSession, count), group, order)
        .sortWithinPartitions(group, order).mapInArrow(scan, schema), name)
    # One row per partition: its first and last group, their sums and first known values.
    edge = scanned.groupBy("_part").agg(
        F.min(F.when(F.col("_first"), F.col(group))).alias("first"),
        F.min(F.when(F.col("_last"), F.col(group))).alias("last"),
        *[F.sum(F.when(F.col("_last"), F.col(old))).alias(f"s{i}")
          for i, old in enumerate(sums.values())],
        *[F.min_by(F.when(F.col("_first"), F.col(old)),
                   F.when(F.col("_first") & F.col(old).isNotNull(), F.col(order))).alias(f"n{i}")
          for i, old in enumerate(nexts.values())])
    parts = sorted(edge.collect(), key=lambda row: row["_part"])
    added, brought, carried = [], [], [0] * len(sums)
    for before, part in zip([None, *parts], parts):
        goes_on = before is not None and before["last"] == part["first"]
        carried = [c if goes_on else 0 for c in carried]
        added.append(list(carried))
        # A partition of one group adds to what came in; else its last group starts there.
        through = part["first"] == part["last"]
        carried = [part[f"s{i}"] + (c if through else 0) for i, c in enumerate(carried)]
    carried = [None] * len(nexts)
    for part, after in zip(parts[::-1], [None, *parts[::-1]]):
        goes_on = after is not None and part["last"] == after["first"]
        if goes_on:
            # ``carried`` is what the partitions after ``after`` bring to its last group.
            through = after["first"] == after["last"]
            carried = [after[f"n{i}"] if after[f"n{i}"] is not None else c if through else None
                       for i, c in enumerate(carried)]
        else:
            carried = [None] * len(nexts)
        brought.append(list(carried))
    carry = T.StructType([T.StructField("_part", T.IntegerType()),
                          *[T.StructField(f"_add{i}", T.LongType()) for i in range(len(sums))],
                          *[T.StructField(f"_next{i}", df.schema[old].dataType)
                            for i, old in enumerate(nexts.values())]])
    rows = [(part["_part"], *a, *b) for part, a, b in zip(parts, added, brought[::-1])]
    carries = F.broadcast(df.sparkSession.createDataFrame(rows, carry))
    return scanned.join(carries, "_part").select(
        *shown,
        *[(F.col(new) + F.when(F.col("_first"), F.col(f"_add{i}")).otherwise(0)).alias(new)
          for i, new in enumerate(sums)],
        *[F.coalesce(new, F.when(F.col("_last"), F.col(f"_next{i}"))).alias(new)
          for i, new in enumerate(nexts)])
