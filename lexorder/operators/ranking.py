"""Rank, dense rank and ties over groups of any size.

``Window.partitionBy(g)`` puts a whole group into one task, and one text (or one repeated key)
may hold a third of all rows.  ``rank_rows`` gives the same numbers without that: rows are range
partitioned on ``(group, key, tie)``, so even rows that share group and key spread over tasks;
each task numbers its own sorted rows; and of the first and last row of each partition a few
numbers and 128-bit hashes of group and key go to the driver, to learn what the partitions before
add.  That summary grows with the number of partitions, never with the rows or the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.staging import Stages

FIRST, LAST = 1, 2      # marks of a partition's first and last row


def rank_bounded(df: DataFrame, group: list[str], key: list[str], tasks: int, stages: Stages,
                 name: str, keep: list[str], cluster: list[str] | None = None,
                 placed: bool = False) -> DataFrame:
    """What ``rank_rows`` returns, by a plain window, for groups of proven bounded size.

    ``cluster`` names the columns to partition by where fewer than ``group`` will do (so that an
    exchange made for a join before is used again).  ``placed`` rows are partitioned so already.
    """
    order = Window.partitionBy(*group).orderBy(*key)
    after = F.struct(*key) if len(key) > 1 else F.col(key[0])
    ranked = (df if placed else df.repartition(tasks, *(cluster or group))).select(
        *keep, F.rank().over(order).alias("_rank"), F.row_number().over(order).alias("_row"),
        (F.lead(after).over(order) == after).alias("_same"))
    return stages.save(ranked.select(
        *keep, (F.col("_rank") - 1).cast("long").alias("rank"),
        ((F.col("_rank") != F.col("_row")) | F.coalesce("_same", F.lit(False))).alias("tied")),
        name, rising=True)


def _changed(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """For rows 1.. of a batch: does any of ``columns`` differ from the row before?"""
    flags = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for name in columns:
        col = batch.column(name)
        flags |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(False)
    return flags


def _number_partition(group: list[str], key: list[str], keep: list[str], what: str):
    """The ``mapInArrow`` function that numbers the sorted rows of one partition.

    ``_local`` is a row's number counted from where its group starts in this partition; ``_open``
    tells that the group may have started in an earlier one.  Only the first and last row keep
    their group and key, with their index and the index at which their group starts.
    """
    shown = keep + [c for c in group + key if c not in keep]

    def values(batch, columns, row):
        return [batch.column(c)[row].as_py() for c in columns]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = 0                    # rows seen so far
        group_at = key_at = 0       # index at which the current group and key start
        keys = -1                   # the current row's dense number
        last_group = last_key = None
        held = None                 # the numbered batch before; its last tie flag is still open

        def emit(batch, at, group_start, local, tied, next_tied, final):
            tied[-1] |= next_tied
            edge = np.zeros(len(tied), dtype=np.int8)
            if at == 0:
                edge[0] |= FIRST
            if final:
                edge[-1] |= LAST
            hidden = edge == 0
            at_edge = pa.array(~hidden)
            columns = [batch.column(c) if c in keep else
                       pc.if_else(at_edge, batch.column(c), pa.scalar(None, batch.column(c).type))
                       for c in shown]
            return pa.RecordBatch.from_arrays(
                columns + [pa.array(np.full(len(tied), part, np.int32)), pa.array(local),
                           pa.array(group_start == 0), pa.array(tied), pa.array(edge),
                           pa.array(np.arange(at, at + len(tied)), mask=hidden),
                           pa.array(group_start, mask=hidden)],
                names=shown + [f.name for f in NUMBERED])

        for batch in batches:
            size = batch.num_rows
            if size == 0:
                continue
            starts_group = np.empty(size, dtype=bool)
            starts_group[0] = rows == 0 or values(batch, group, 0) != last_group
            starts_group[1:] = _changed(batch, group)
            starts_key = starts_group.copy()
            starts_key[0] |= values(batch, key, 0) != last_key
            starts_key[1:] |= _changed(batch, key)
            if held is not None:
                yield emit(*held, not starts_key[0], False)

            index = np.arange(rows, rows + size)
            group_start = np.maximum.accumulate(np.where(starts_group, index, group_at))
            if what == "row":
                local = index - group_start
            elif what == "dense":
                seen = np.cumsum(starts_key)
                local = seen - 1 - np.maximum.accumulate(
                    np.where(starts_group, seen - 1, -1 - keys))
                keys = int(local[-1])
            else:
                key_start = np.maximum.accumulate(np.where(starts_key, index, key_at))
                key_at = int(key_start[-1])
                local = key_start - group_start
            tied = ~starts_key
            tied[:-1] |= ~starts_key[1:]
            held = (batch, rows, group_start, local, tied)
            rows += size
            group_at = int(group_start[-1])
            last_group, last_key = values(batch, group, size - 1), values(batch, key, size - 1)
        if held is not None:
            yield emit(*held, False, True)

    return number


NUMBERED = [
    T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType()),
    T.StructField("_open", T.BooleanType()), T.StructField("_tied", T.BooleanType()),
    T.StructField("_edge", T.ByteType()), T.StructField("_index", T.LongType()),
    T.StructField("_group_at", T.LongType()),
]
CARRY = "_part int, _add_first long, _add long, _from_before boolean, _goes_on boolean"


def _hash(columns: list[str]) -> Column:
    """128 bits that tell values of ``columns`` apart."""
    seeded = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    return F.array(*seeded)


def _carries(edges: list, what: str) -> list[tuple]:
    """What the open group of each partition takes over from the partitions before it.

    One row per partition: what to add to an open row's number if it has the partition's very
    first key, what to add otherwise, and whether the first and the last key cross its borders.
    """
    firsts = {e["_part"]: e for e in edges if e["_edge"] & FIRST}
    lasts = {e["_part"]: e for e in edges if e["_edge"] & LAST}
    out, offset, before = [], 0, None
    group_at = key_at = number = 0      # of the last row before: global indexes, dense number
    for part in sorted(firsts):
        first, last = firsts[part], lasts[part]
        same_group = before is not None and before["_group"] == first["_group"]
        same_key = same_group and before["_key"] == first["_key"]
        if same_key:
            out[-1][4] = True
        if not same_group:
            group_at, number = offset, 0
        elif not same_key:
            number += 1
        if not same_key:
            key_at = offset
        add = number if what == "dense" else offset - group_at
        add_first = key_at - group_at if what == "rank" else add
        out.append([part, add_first, add, same_key, False])
        if not last["_open"]:
            group_at, number = offset + last["_group_at"], last["_local"]
            key_at = group_at + last["_local"]
        else:
            number += last["_local"]
            if last["_local"] > 0:
                key_at = offset + last["_local"]
        offset += last["_index"] + 1
        before = last
    return [tuple(row) for row in out]


def rank_rows(df: DataFrame, group: list[str], key: list[str], tie: list[str], tasks: int,
              stages: Stages, name: str, keep: list[str] | None = None,
              what: str = "rank") -> DataFrame:
    """Number the rows of every group in key order, from 0, however large the group.

    Returns ``keep`` (default: group and tie) with ``rank`` and ``tied``.  ``rank`` is the least
    row number of the row's key in its group, the number of smaller keys (``what='dense'``) or
    the row's own number (``what='row'``); ``tied`` tells whether another row shares the key.
    ``group``, ``key`` and ``tie`` together should tell rows apart (or large ties stay in one
    task); no column may be null.
    """
    keep = keep if keep is not None else group + [c for c in tie if c not in group]
    order = group + [c for c in key if c not in group]
    order += [c for c in tie if c not in order]
    shown = keep + [c for c in group + key if c not in keep]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in shown] + NUMBERED)
    numbered = stages.save(
        df.select(*dict.fromkeys(order + keep))
        .repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .mapInArrow(_number_partition(group, key, keep, what), schema), name, rising=True)

    # At most two rows per partition.
    edges = numbered.filter("_edge > 0").select(
        "_part", "_local", "_open", "_edge", "_index", "_group_at", _hash(group).alias("_group"),
        _hash(key).alias("_key")).collect()
    carries = df.sparkSession.createDataFrame(_carries(edges, what), CARRY)
    first_key = F.col("_local") == 0
    carried = F.when(~F.col("_open"), 0).when(first_key, F.col("_add_first")).otherwise(
        F.col("_add"))
    tied = (F.col("_tied")
            | (F.col("_edge").bitwiseAND(FIRST) > 0) & F.col("_from_before")
            | (F.col("_edge").bitwiseAND(LAST) > 0) & F.col("_goes_on"))
    return (numbered.join(F.broadcast(carries), "_part")
            .select(*keep, (F.col("_local") + carried).alias("rank"), tied.alias("tied")))
