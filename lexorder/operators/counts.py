"""Counts per first symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.operators.types import decode
from lexorder.sources.texts import Texts


ZEROS = 1 << 20     # zeros of a gap that one row brings


def symbol_histogram(texts: Texts) -> DataFrame:
    """``(text_id, sym, count)`` of the symbols that occur: the bucket sizes of the suffix array.

    Symbols are counted chunk by chunk where the chunks lie; only counts are exchanged.
    """
    width = texts.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("text_id"), batch.column("len").to_pylist()
            for row, size in enumerate(sizes):
                raw = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
                sym, n = np.unique(decode(raw[:size * width], width), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([row] * len(sym))), pa.array(sym.astype(np.int64)),
                     pa.array(n)], names=["text_id", "sym", "n"])

    schema = T.StructType([texts.chunks.schema["text_id"], T.StructField("sym", T.LongType()),
                           T.StructField("n", T.LongType())])
    return (texts.chunks.select("text_id", "len", "data").mapInArrow(count, schema)
            .groupBy("text_id", "sym").agg(F.sum("n").alias("count")))


def bucket_starts(histogram: DataFrame) -> DataFrame:
    """``(text_id, sym, count, start)``: the rank at which the suffixes with a symbol begin.

    The window runs over the histogram, one row per distinct symbol of a text.
    """
    smaller = (Window.partitionBy("text_id").orderBy("sym")
               .rowsBetween(Window.unboundedPreceding, -1))
    return histogram.select("text_id", "sym", "count",
                            F.coalesce(F.sum("count").over(smaller), F.lit(0)).alias("start"))


def dense_counts(typed: DataFrame, flag: str) -> DataFrame:
    """``(text_id, sym, count)`` of flagged positions, with zeros for symbols down to 0.

    The list of a text ends at its largest flagged symbol; a text without any has no rows.
    """
    counts = (typed.filter(flag).groupBy("text_id", "sym").agg(F.count("*").alias("count")))
    below = Window.partitionBy("text_id").orderBy("sym")
    # Each symbol brings the zeros between itself and the next smaller one that occurs, by rows
    # of bounded size that are spread over the tasks.
    gaps = (counts
            .withColumn("low", F.coalesce(F.lag("sym").over(below) + 1, F.lit(0)))
            .withColumn("low", F.explode(F.sequence("low", "sym", F.lit(ZEROS).cast("long"))))
            .withColumn("high", F.least("sym", F.col("low") + (ZEROS - 1))))
    return (gaps.repartition("text_id", "low")
            .withColumn("at", F.explode(F.sequence("low", "high")))
            .select("text_id", F.col("at").alias("sym"),
                    F.when(F.col("at") == F.col("sym"), F.col("count")).otherwise(0)
                    .alias("count")))


def star_counts(typed: DataFrame, kind: str = "minus") -> DataFrame:
    """Minus-star or plus-star positions per first symbol, dense."""
    if kind not in ("minus", "plus"):
        raise ValueError("kind must be 'minus' or 'plus'")
    return dense_counts(typed, f"is_{kind}_star")


def plus_counts(typed: DataFrame) -> DataFrame:
    """Plus suffixes per first symbol, dense."""
    return dense_counts(typed, "NOT is_minus")


def type_counts(typed: DataFrame) -> DataFrame:
    """``(text_id, sym, n_minus, n_plus)``: suffixes of either kind per first symbol."""
    return typed.groupBy("text_id", "sym").agg(
        F.count_if("is_minus").alias("n_minus"), F.count_if(~F.col("is_minus")).alias("n_plus"))


def text_summary(typed: DataFrame, n_names: DataFrame) -> DataFrame:
    """One row per text: length, distinct symbols, largest symbol, stars and names.

    Sizes first combine per symbol, so a long text arrives as one row per symbol and task.
    """
    per_symbol = typed.groupBy("text_id", "sym").agg(
        F.count("*").alias("n"), F.count_if("is_minus").alias("minus"),
        F.count_if("is_minus_star").alias("minus_stars"),
        F.count_if("is_plus_star").alias("plus_stars"))
    sizes = per_symbol.groupBy("text_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_symbols"), F.max("sym").alias("max_sym"),
        F.sum("minus").alias("n_minus"), F.sum("minus_stars").alias("n_minus_stars"),
        F.sum("plus_stars").alias("n_plus_stars"))
    return (sizes.join(n_names, "text_id", "left")
            .withColumn("n_names", F.coalesce("n_names", F.lit(0))))
