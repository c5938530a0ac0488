"""Ranks by position, packed in one row per chunk, in buckets that never move.

A round of prefix doubling asks for the ranks of some positions and then changes some.  As rows,
all ranks would be exchanged in every round.  Here a chunk's ranks are one binary value, and the
chunks are written bucketed by text and chunk: rows that look up and rows that change go to the
buckets, and the arrays are read where they lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.sources.texts import Texts
from lexorder.staging import Stages, shuffles_removed, tasks_for

KEY = ["text_id", "chunk_id"]
HELD_ROWS = 1 << 18     # rows that are packed together before they are exchanged
BLOBS = 1 << 12         # packed rows of one batch


def encode(values: np.ndarray, width: int) -> np.ndarray:
    """Integers as rows of ``width`` big-endian bytes."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:]


def _held(width: int, chunk: int):
    """The ``mapInArrow`` function that packs rows before they are exchanged.

    Rows that lie near one another are brought in order, and those of a chunk become one row, with
    the differences of their offsets and their values.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_ROWS:
                yield from rows(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from rows(pa.Table.from_batches(held))

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, pos = table.column("text_id").combine_chunks(), table.column("pos").to_numpy()
        text = np.zeros(len(pos), dtype=np.int64)
        text[1:] = np.cumsum(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(
            False))
        order = np.lexsort((pos, text))
        text, pos = text[order], pos[order]
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (pos[1:] // chunk != pos[:-1] // chunk)
        starts = np.flatnonzero(new)
        off = pos % chunk
        steps = np.diff(off, prepend=0).astype("<i4")
        steps[starts] = off[starts]
        raw = encode(table.column("value").to_numpy()[order], width)
        cuts = np.append(starts, len(pos)).astype(np.int32)
        for at in range(0, len(starts), BLOBS):
            some = slice(at, at + BLOBS)
            cut = cuts[at:at + BLOBS + 1]
            first, last = cut[0], cut[-1]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(order[starts[some]])), pa.array(pos[starts[some]] // chunk),
                 *(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [
                     None, pa.py_buffer(np.ascontiguousarray((cut - first) * size)),
                     pa.py_buffer(np.ascontiguousarray(block[first:last]))])
                   for block, size in ((steps, 4), (raw, width)))],
                names=[*KEY, "steps", "values"])

    return pack


def _merged(width: int):
    """The ``mapInArrow`` function that makes a chunk's ranks of its packed parts."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, values = batch.column("steps"), batch.column("values")
            out = []
            for row in range(batch.num_rows):
                off = np.concatenate([np.cumsum(np.frombuffer(part, "<i4"))
                                      for part in steps[row].as_py()])
                raw = np.frombuffer(b"".join(values[row].as_py()), np.uint8).reshape(-1, width)
                out.append(raw[np.argsort(off, kind="stable")].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in KEY], pa.array(out, pa.binary())],
                names=[*KEY, "ranks"])

    return merge


def _patched(width: int):
    """The ``mapInArrow`` function that puts a chunk's changes into its ranks."""
    def patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, changes = batch.column("ranks"), batch.column("changes")
            cuts = np.frombuffer(ranks.buffers()[1], np.int32)[
                ranks.offset:ranks.offset + len(ranks) + 1]
            raw = np.frombuffer(ranks.buffers()[2] or b"", np.uint8)[cuts[0]:cuts[-1]].copy()
            size = pc.list_value_length(changes).fill_null(0).to_numpy()
            off, value = (f.to_numpy() for f in changes.flatten().flatten())
            at = np.repeat((cuts[:-1] - cuts[0]) // width, size) + off
            raw.reshape(-1, width)[at] = encode(value, width)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in KEY],
                 pa.Array.from_buffers(pa.binary(), len(ranks), [
                     None, pa.py_buffer(np.ascontiguousarray(cuts - cuts[0])),
                     pa.py_buffer(raw)])],
                names=[*KEY, "ranks"])

    return patch


class RankArrays:
    """The ranks of all positions of some texts, as they are after the last change.

    Each text's end has the least value of all, so that a suffix that stops sorts first.
    ``known`` has ``text_id, pos, rank`` for every position.  Call ``drop`` at the end.
    """

    def __init__(self, known: DataFrame, texts: Texts, total: int, stages: Stages, name: str):
        self.chunk, self.stages, self.name = texts.chunk, stages, name
        longest = texts.chunks.agg(F.max(F.col("beg") + F.col("len"))).first()[0] or 0
        self.width = max(1, -(-longest.bit_length() // 8))
        self.tasks = tasks_for(known.sparkSession, total)
        self.schema = T.StructType([
            known.schema["text_id"], T.StructField("chunk_id", T.LongType()),
            T.StructField("ranks", T.BinaryType())])
        self.version, self.table = 0, None
        ends = texts.chunks.filter("last").select(
            "text_id", (F.col("beg") + F.col("len")).alias("pos"), F.lit(0).cast("long")
            .alias("value"))
        rows = known.select("text_id", "pos", (F.col("rank") + 1).alias("value")).unionByName(ends)
        packed = T.StructType([*self.schema.fields[:2], T.StructField("steps", T.BinaryType()),
                               T.StructField("values", T.BinaryType())])
        parts = F.collect_list(F.struct("steps", "values"))
        self._write(rows.mapInArrow(_held(self.width, self.chunk), packed)
                    .repartition(self.tasks, *KEY).groupBy(*KEY).agg(parts.alias("parts"))
                    .select(*KEY, "parts.steps", "parts.values")
                    .mapInArrow(_merged(self.width), self.schema))

    def _to_buckets(self, rows: DataFrame) -> DataFrame:
        return (rows.withColumn("chunk_id", F.expr(f"pos div {self.chunk}"))
                .repartition(self.tasks, *KEY))

    def _write(self, arrays: DataFrame) -> None:
        """Write the next version.  The partitions are the buckets, so each is one file."""
        before, path = self.table, f"{self.name}-{self.version}"
        self.table, self.version = f"lexorder_{uuid.uuid4().hex}", self.version + 1
        with shuffles_removed(self.stages.spark):
            (arrays.write.format("parquet").bucketBy(self.tasks, *KEY)
             .option("compression", "zstd")
             .option("path", f"{self.stages.folder}/{path}").saveAsTable(self.table))
        if before:
            self._forget(before, self.version - 2)

    def _forget(self, table: str, version: int) -> None:
        self.stages.spark.sql(f"DROP TABLE {table}")
        self.stages.remove(f"{self.name}-{version}")

    def arrays(self) -> DataFrame:
        return self.stages.spark.table(self.table)

    def change(self, rows: DataFrame) -> None:
        """Take over the ``rank`` of rows ``text_id, pos, rank``."""
        changes = (self._to_buckets(rows).groupBy(*KEY).agg(F.collect_list(F.struct(
            F.expr(f"pos % {self.chunk}").alias("off"), (F.col("rank") + 1).alias("value")))
            .alias("changes")))
        self._write(self.arrays().join(changes.hint("shuffle_hash"), KEY, "left")
                    .mapInArrow(_patched(self.width), self.schema))

    def look_up(self, rows: DataFrame, depth: int) -> DataFrame:
        """Add ``next``, which compares like the rank of the suffix ``depth`` symbols in.

        That position is in the text or its end.
        """
        wanted = self._to_buckets(rows.withColumn("_open", F.col("pos"))
                                  .withColumn("pos", F.col("pos") + depth))
        at = (F.expr(f"pos % {self.chunk}") * self.width + 1).cast("int")
        return wanted.hint("shuffle_hash").join(self.arrays(), KEY).withColumn(
            "next", F.substring(F.col("ranks"), at, F.lit(self.width))).withColumn(
            "pos", F.col("_open")).select(*rows.columns, "next")

    def drop(self) -> None:
        self._forget(self.table, self.version - 1)
