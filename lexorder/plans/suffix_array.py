"""Suffix arrays of text columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexorder.plans.doubling import (Packed, chunk_orders, chunk_ties, direct, doubling,
                                     first_order, refine, union)
from lexorder.plans.induced import induced
from lexorder.sources.texts import CHUNK, HALO, Texts, chunk_texts
from lexorder.staging import Stages, default_tasks

MANY_TIES = 0.75        # share of suffixes tied on their prefix that makes a text repetitive
WORTH = 0.25            # share of all suffixes in such texts from which levels of names pay


def automatic(texts: Packed, stages: Stages, name: str = "auto") -> DataFrame:
    """``doubling``, and ``induced`` for the texts of which many suffixes tie after round 0.

    Levels of names are many jobs, so a few such texts among others are refined with them.  Texts
    of one chunk that ``doubling`` is for are sorted in the task that holds the chunk, each time
    the result is read.
    """
    if texts.single:
        ties = chunk_ties(texts)
    else:
        ranked, symbols = first_order(texts, stages, name)
        ties = ranked.groupBy("text_id").agg(F.count("*").alias("n"),
                                             F.count_if("tied").alias("ties"))
    many = ties.filter(F.col("ties") > MANY_TIES * F.col("n"))
    total = many.agg(F.sum("n")).first()[0] or 0
    if total <= WORTH * texts.total:
        return chunk_orders(texts) if texts.single else refine(ranked, symbols, texts, stages,
                                                               name)
    repetitive = stages.save(many, f"{name}-repetitive")
    parts = [induced(replace(texts, total=total, chunks=texts.chunks.join(
        repetitive, "text_id", "left_semi")), stages, f"{name}-induced")]
    if total < texts.total:
        others = replace(texts, total=texts.total - total, chunks=texts.chunks.join(
            repetitive, "text_id", "left_anti"))
        if texts.single:
            parts.append(chunk_orders(others))
        else:
            rest = stages.save(ranked.join(repetitive, "text_id", "left_anti"), f"{name}-others")
            parts.append(refine(rest, symbols, others, stages, f"{name}-refined"))
    return union(parts)


PLANS = {"auto": automatic, "direct": direct, "doubling": doubling, "induced": induced}


def suffix_array(df: DataFrame, id_col: str, text_col: str, unit: str = "byte",
                 method: str = "auto", symbol_bytes: int | None = None, chunk: int = CHUNK,
                 halo: int = HALO) -> DataFrame:
    """The suffix array of every text: ``(text_id, rank, pos)``.

    Symbols compare as unsigned integers and a suffix that is a proper prefix of another sorts
    first.  ``unit`` is ``'byte'`` (strings as UTF-8), ``'char'`` (code points) or ``'token'``
    (arrays of non-negative integers).  ``method`` is ``'direct'`` (symbols only),
    ``'doubling'``, ``'induced'`` (over texts of names; for long repeats) or ``'auto'``, which
    chooses between these two for each text; all give the same rows.  Null and repeated ids are
    errors; null and empty texts give no rows.  Runs jobs when called and returns a reader of
    stage tables.
    """
    return sort_texts(chunk_texts(df, id_col, text_col, unit, symbol_bytes, chunk, halo,
                                  default_tasks(df.sparkSession)), method)


def sort_texts(texts: Texts, method: str = "auto") -> DataFrame:
    """The suffix array ``(text_id, rank, pos)`` of packed texts.

    Texts of one chunk are groups of bounded size and go through plain windows, or are sorted in
    one piece (``auto``); the others are split over tasks however long they are.
    """
    if method not in PLANS:
        raise ValueError(f"unknown method {method!r}")
    stages = Stages(texts.chunks.sparkSession)
    chunks = stages.save(texts.chunks, "chunks")
    twice = chunks.groupBy("text_id", "chunk_id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"two texts have the id {twice['text_id']!r}")
    single = (F.col("chunk_id") == 0) & F.col("last")
    totals = {row["single"]: row["total"] for row in chunks.groupBy(single.alias("single")).agg(
        F.sum("len").alias("total")).collect()}
    orders = [PLANS[method](Packed(chunks.filter(single if one else ~single), texts.width,
                                   texts.chunk, texts.halo, one, total),
                            stages, f"{method}-{'single' if one else 'long'}")
              for one, total in totals.items()]
    if not orders:
        return chunks.select("text_id", F.col("beg").alias("rank"), F.col("beg").alias("pos"))
    if method != "auto":        # which reads the chunks whenever the result is read
        stages.remove("chunks")
    return union(orders)
