"""Look-ups between suffix arrays, stars and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexorder.operators.order_check import order_errors
from lexorder.operators.ranking import rank_rows
from lexorder.operators.scans import scan_rows
from lexorder.sources.texts import Texts, symbol_value
from lexorder.staging import Stages, default_tasks


def preceding_symbol(sa: DataFrame, texts: Texts) -> DataFrame:
    """``(text_id, rank, pos, prev_sym)``: the symbol before each suffix, null at the text's start.

    Suffixes meet packed chunks, at most one chunk's worth of them each.
    """
    held = texts.chunks.select("text_id", "chunk_id", "beg", "prev", "data")
    at = ((F.col("pos") - 1 - F.col("beg")) * texts.width + 1).cast("int")
    before = F.when(F.col("pos") == F.col("beg"), F.col("prev")).otherwise(
        F.substring(F.col("data"), at, F.lit(texts.width)))
    return (sa.withColumn("chunk_id", F.expr(f"pos div {texts.chunk}"))
            .join(held, ["text_id", "chunk_id"])
            .select("text_id", "rank", "pos",
                    symbol_value(before, texts.width).alias("prev_sym")))


def first_symbol(order: DataFrame, texts: Texts) -> DataFrame:
    """``order`` with ``sym``, the symbol at ``pos``; suffixes meet packed chunks."""
    held = texts.chunks.select("text_id", "chunk_id", "beg", "data")
    at = ((F.col("pos") - F.col("beg")) * texts.width + 1).cast("int")
    symbol = F.substring(F.col("data"), at, F.lit(texts.width))
    return (order.withColumn("chunk_id", F.expr(f"pos div {texts.chunk}"))
            .join(held, ["text_id", "chunk_id"])
            .select(*order.columns, symbol_value(symbol, texts.width).alias("sym")))


def merge_orders(minus: DataFrame, plus: DataFrame, counts: DataFrame, texts: Texts,
                 stages: Stages | None = None) -> DataFrame:
    """One order ``(text_id, rank, pos)`` of the minus and the plus suffixes, without a sort.

    Suffixes with one first symbol are a bucket, its minus suffixes before its plus suffixes.  So
    a minus suffix is behind the plus suffixes of smaller buckets only, and a plus suffix behind
    the minus suffixes of its own bucket too: both are running sums over ``counts``, the
    ``(text_id, sym, n_minus, n_plus)`` of all buckets.
    """
    stages = stages or Stages(minus.sparkSession)
    buckets = stages.save(counts, "buckets")
    offsets = scan_rows(buckets, "text_id", "sym", {"minus_before": "n_minus",
                                                    "plus_before": "n_plus"}, {},
                        buckets.count(), stages, "offsets").select(
        "text_id", "sym", F.col("plus_before").alias("to_minus"),
        (F.col("minus_before") + F.col("n_minus")).alias("to_plus"))
    parts = [first_symbol(order.select("text_id", "rank", "pos"), texts)
             .join(offsets, ["text_id", "sym"])
             .select("text_id", (F.col("rank") + F.col(offset)).alias("rank"), "pos")
             for order, offset in ((minus, "to_minus"), (plus, "to_plus"))]
    return parts[0].unionByName(parts[1])


def star_suffix_order(stars: DataFrame, reduced_sa: DataFrame) -> DataFrame:
    """``(text_id, rank, pos)``: star positions in suffix order, from the reduced text's order."""
    order = reduced_sa.select("text_id", "rank", F.col("pos").alias("star_idx"))
    return (stars.select("text_id", "star_idx", "pos").join(order, ["text_id", "star_idx"])
            .select("text_id", "rank", "pos"))


def order_within(sa: DataFrame, chosen: DataFrame, stages: Stages | None = None,
                 tasks: int | None = None) -> DataFrame:
    """``(text_id, rank, pos)`` of the suffixes at the chosen ``(text_id, pos)``, ranked anew."""
    kept = sa.join(chosen.select("text_id", "pos"), ["text_id", "pos"], "left_semi")
    spark = sa.sparkSession
    return rank_rows(kept, ["text_id"], ["rank"], ["pos"], tasks or default_tasks(spark),
                     stages or Stages(spark), "chosen",
                     keep=["text_id", "pos"]).select("text_id", "rank", "pos")


def suffix_order_errors(sa: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per broken rule of a claimed suffix array; none if it is right.

    Checks that ranks and positions are one to one with the text's positions, and that each
    suffix is smaller than the next in rank: by its first symbol or, where that is equal, by the
    ranks of the two suffixes one symbol on.

    Both tables have a row per symbol.  They are packed where they lie and meet by position, and
    then by rank, in stretches of bounded size (see ``order_check``).
    """
    return order_errors(sa, symbols)
