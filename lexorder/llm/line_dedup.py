"""Removing repeated passages of lines by overlapping three-line windows.

Every three consecutive lines of a text are one window.  Windows that occur more than once in the
table are found by their hash (128 bits); all but the first occurrence, by id and then by place in
the text, are covered, and a text loses every line that a covered window holds.  Overlapping and
touching windows are merged.

Windows are small rows; a hash is counted and its first place found before the shuffle, so a
window that a third of the texts share is one row per task.  Only the join that hands the first
place out meets the hot hash, on the side that adaptive execution splits.

Defined results: lines end at line feeds and compare as they are.  A window of three empty lines
does not count.  A text of fewer than three lines stays as it is, a null text stays null with 0
lines.  Null ids come last.  Rows that repeat both id and text are one document and get the same
result each; rows that repeat only the id are ordered by the text's hash.  Extra columns do not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages

WINDOW = 3


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often lambdas in ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(lines: Column, size: int) -> Column:
    """Array of structs (at, low, high) of the windows that are not empty lines only."""
    def made(a):
        def window(i):
            part = [F.get(a, i + k) for k in range(size)]
            return F.struct(i.alias("at"), F.xxhash64(*part).alias("low"),
                            F.xxhash64(F.lit(size), *part[::-1]).alias("high"))

        def empty(i):
            return F.concat(*[F.get(a, i + k) for k in range(size)]) == ""

        starts = F.filter(F.sequence(F.lit(0), F.size(a) - size), lambda i: ~empty(i))
        return F.when(F.size(a) >= size, F.transform(starts, window))

    return _once(lines, made)


def covered_windows(rows: DataFrame, stages: Stages, size: int = WINDOW) -> DataFrame:
    """Rows (id, hash, text) to (id, hash, at): windows that occurred before."""
    found = stages.save(
        rows.select("id", "hash", F.explode(_windows(F.split("text", "\n", -1), size))
                    .alias("w")).select("id", "hash", "w.*"), "windows")
    order = F.struct(F.isnull("id").alias("none"), "id", "hash", "at")
    first = (found.groupBy("low", "high").agg(F.min(order).alias("first"),
                                              F.count("*").alias("times"))
             .filter("times > 1").select("low", "high", "first"))
    return (found.join(first.hint("merge"), ["low", "high"])
            .filter(~(F.col("id").eqNullSafe(F.col("first.id"))
                      & (F.col("hash") == F.col("first.hash"))
                      & (F.col("at") == F.col("first.at")))).select("id", "hash", "at"))


def _kept(lines: Column, at: Column, size: int) -> Column:
    """The lines between the covered windows; ``at`` are their starts, ascending."""
    last = F.size(at)

    def kept(a):
        def piece(i):
            begin = F.when(i == 0, 0).otherwise(F.get(at, i - 1) + size)
            end = F.when(i == last, F.size(a)).otherwise(F.get(at, i))
            return F.slice(a, begin + 1, F.greatest(F.lit(0), end - begin))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), piece))

    return _once(lines, kept)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   size: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, without later copies of windows."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"),
                       F.col(text).alias("text"))
    covered = stages.save(
        covered_windows(rows, stages, size).groupBy("id", "hash")
        .agg(F.array_sort(F.collect_set("at")).alias("covered"))
        .withColumnsRenamed({"id": "of", "hash": "of_hash"}), "covered")
    # The covered windows have no bound, so they are never broadcast, however few there are.
    joined = rows.join(covered.hint("merge"), rows["id"].eqNullSafe(covered["of"])
                       & (rows["hash"] == covered["of_hash"]), "left")
    lines = F.split("text", "\n", -1)
    count = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    # A struct, so that the lines that are kept are worked out once for both columns.
    result = F.when(F.col("covered").isNull(), F.struct(
        F.col("text").alias("text"), F.lit(0).cast("long").alias("n_removed"))).otherwise(
        _once(_kept(lines, F.col("covered"), size), lambda kept: F.struct(
            F.array_join(kept, "\n").alias("text"),
            (F.size(lines) - F.size(kept)).cast("long").alias("n_removed"))))
    return (joined.select("id", count.alias("n_lines"), result.alias("result"))
            .select(F.col("id").alias("doc_id"), "result.text", "n_lines", "result.n_removed"))
