"""Names of star substrings and the reduced text they spell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexorder.functions.ints import pack_big_endian
from lexorder.operators.ranking import rank_rows
from lexorder.staging import Stages, default_tasks, tasks_for

BROADCAST_NAMES = 200_000       # a name table of up to this many rows and bytes is broadcast
BROADCAST_BYTES = 16 << 20
BOUNDED = 1 << 17   # rows of a text that one task ranks
FAN = 4096      # names that make up a value of the next round


def name_substrings(stars: DataFrame, stages: Stages | None = None,
                    tasks: int | None = None) -> DataFrame:
    """Dense names, from 0, of each text's star substrings in their order.

    Equal substrings share a name; the one that ends the text sorts before an equal one that
    does not.  ``(text_id, star_idx, pos, name)``.
    """
    spark = stars.sparkSession
    rows = stars.select("text_id", "star_idx", "pos", "sub",
                        (~F.col("terminal")).alias("goes_on"))
    return rank_rows(rows, ["text_id"], ["sub", "goes_on"], ["pos"], tasks or default_tasks(spark),
                     stages or Stages(spark), "names", keep=["text_id", "star_idx", "pos"],
                     what="dense").select("text_id", "star_idx", "pos",
                                        F.col("rank").alias("name"))


def count_names(stars: DataFrame) -> DataFrame:
    """``(text_id, n_names)``: distinct star substrings of every text that has a star."""
    return stars.groupBy("text_id").agg(
        F.count_distinct("sub", "terminal").alias("n_names"))


def name_order(order: DataFrame, stages: Stages | None = None,
               tasks: int | None = None, bounded: bool = False) -> DataFrame:
    """``(text_id, star_idx, pos, name)``: dense names from an order of the star substrings.

    ``order`` is ``(text_id, star_idx, rank, pos)`` with equal ranks for equal substrings, so no
    substring is looked at.  ``bounded`` says that every text is a group of bounded size.
    """
    spark = order.sparkSession
    keep = ["text_id", "star_idx", "pos"]
    if bounded:
        name = F.dense_rank().over(Window.partitionBy("text_id").orderBy("rank")) - 1
        return order.repartition(tasks or default_tasks(spark), "text_id").select(
            *keep, name.cast("long").alias("name"))
    return rank_rows(order.select(*keep, "rank"), ["text_id"], ["rank"], ["pos"],
                     tasks or default_tasks(spark), stages or Stages(spark), "named", keep=keep,
                     what="dense").select(*keep, F.col("rank").alias("name"))


def count_ranks(order: DataFrame) -> DataFrame:
    """``(text_id, n_names)``: distinct star substrings per text, from their order.

    Equal substrings combine before they are exchanged, as one row per task.
    """
    return (order.select("text_id", "rank").distinct().groupBy("text_id")
            .agg(F.count("*").alias("n_names")))


def names_by_pairs(symbols: DataFrame, stages: Stages | None = None,
                   tasks: int | None = None) -> DataFrame:
    """``(text_id, star_idx, pos, name)``: dense names of star substrings, by naming pairs.

    ``symbols`` are ``(text_id, star_idx, pos, sym)`` of the substrings.  In each round two
    stretches that follow each other within a substring get one name, the rank of (name of the
    first, name of its tail) among the text's pairs; a stretch without a tail has -1 there and
    comes first.  Stretches are twice as long, and half as many, in every round.  Texts of up to
    ``BOUNDED`` rows are exchanged once; the rows of longer ones are spread over tasks in each round.
    """
    spark = symbols.sparkSession
    stages = stages or Stages(spark)
    symbols = stages.save(symbols, "pair-symbols")
    stars = stages.save(symbols.groupBy("text_id", "star_idx").agg(
        F.min("pos").alias("star_pos"), F.max("pos").alias("end"), F.count("*").alias("n")),
        "pair-stars")
    sizes = stages.save(stars.groupBy("text_id").agg(
        F.sum("n").alias("n"), F.max(F.col("end") - F.col("star_pos")).alias("longest")),
        "pair-sizes")
    bounded = F.col("n") <= BOUNDED
    found = {row["bounded"]: row for row in sizes.groupBy(bounded.alias("bounded")).agg(
        F.sum("n").alias("n"), F.max("longest").alias("longest")).collect()}
    parts = []
    for few, row in found.items():
        those = symbols
        if len(found) > 1:
            those = symbols.join(sizes.filter(bounded if few else ~bounded), "text_id", "left_semi")
        count = tasks or max(tasks_for(spark, row["n"]), 1)
        parts.append(_pairs_by_window(those, row["longest"], count) if few else
                     _pairs_by_rows(those, stars, row["longest"], stages, count))
    if not parts:
        return symbols.select("text_id", "star_idx", "pos", F.col("sym").alias("name"))
    return reduce(DataFrame.unionByName, parts)


KEY = ["text_id", "star_idx"]


def _pairs(named: DataFrame, also: list[str]) -> DataFrame:
    """Pairs of stretches: the names of the first and of its tail, -1 without one."""
    second = F.col("k") % 2 == 1
    return named.groupBy(*KEY, *also, F.expr("k div 2").alias("half")).agg(
        F.max(F.when(~second, F.col("name"))).alias("name"),
        F.coalesce(F.max(F.when(second, F.col("name"))), F.lit(-1)).alias("tail_name"))


def _pairs_by_window(symbols: DataFrame, longest: int, tasks: int) -> DataFrame:
    """The rounds for texts of bounded size: one exchange by text, then windows in place."""
    text, star = Window.partitionBy("text_id"), Window.partitionBy(*KEY)

    def dense(*key: str) -> Column:
        return (F.dense_rank().over(text.orderBy(*key)) - 1).cast("long")

    begin = F.min("pos").over(star)
    named = symbols.repartition(tasks, "text_id").select(
        *KEY, (F.col("pos") - begin).alias("k"), F.col("sym").alias("name"),
        begin.alias("star_pos"))
    while longest:
        named = _pairs(named, ["star_pos"]).select(
            *KEY, F.col("half").alias("k"), dense("name", "tail_name").alias("name"), "star_pos")
        longest //= 2
    whole = named.withColumn("goes_on", F.col("star_idx") < F.max("star_idx").over(text))
    return whole.select(*KEY, F.col("star_pos").alias("pos"), dense("name", "goes_on")
                        .alias("name"))


def _pairs_by_rows(symbols: DataFrame, stars: DataFrame, longest: int, stages: Stages,
                   tasks: int) -> DataFrame:
    """The rounds for texts of any size: rows of one text are ranked in many tasks."""
    named = symbols.join(stars, KEY).select(
        *KEY, (F.col("pos") - F.col("star_pos")).alias("k"), F.col("sym").alias("name"))
    turn = 0
    while longest:
        # Staged, as the range exchange reads its rows twice.
        pairs = stages.save(_pairs(named, []), f"pairs-{turn}-rows")
        named = rank_rows(pairs, ["text_id"], ["name", "tail_name"], ["star_idx", "half"], tasks,
                          stages, f"pairs-{turn}", keep=[*KEY, "half"], what="dense").select(
            *KEY, F.col("half").alias("k"), F.col("rank").alias("name"))
        turn, longest = turn + 1, longest // 2
    last = stars.groupBy("text_id").agg(F.max("star_idx").alias("last_star"))
    whole = named.join(stars, KEY).join(last, "text_id").select(
        *KEY, F.col("star_pos").alias("pos"), "name",
        (F.col("star_idx") < F.col("last_star")).alias("goes_on"))
    return rank_rows(whole, ["text_id"], ["name", "goes_on"], ["pos"], tasks, stages, "whole",
                     keep=[*KEY, "pos"], what="dense").select(*KEY, "pos",
                                                              F.col("rank").alias("name"))


def reduced_text(names: DataFrame) -> DataFrame:
    """The names in text order as a text of their own: ``(text_id, pos, sym)``."""
    return names.select("text_id", F.col("star_idx").alias("pos"), F.col("name").alias("sym"))


def pair_names(symbols: DataFrame, stages: Stages | None = None,
               tasks: int | None = None) -> DataFrame:
    """Dense names of ``(sym, tail_is_plus, tail_name)`` within each text, from 0.

    Takes ``text_id, pos, sym, tail_is_plus, tail_name``; returns ``(text_id, pos, name)``.
    """
    spark = symbols.sparkSession
    return rank_rows(symbols, ["text_id"], ["sym", "tail_is_plus", "tail_name"], ["pos"],
                     tasks or default_tasks(spark), stages or Stages(spark), "pairs",
                     what="dense").select("text_id", "pos", F.col("rank").alias("name"))


def sequence_ranks(parts: DataFrame, key: list[str], stages: Stages, name: str) -> DataFrame:
    """Dense ranks, from 0, of lists of values: ``(*key, rank)``.

    ``parts`` has ``key``, ``k`` (0, 1, ... within the key) and a binary ``value``; lists compare
    value by value, and a list that another one goes on from comes first.  Values get names, and up
    to ``FAN`` names in a row are a value of the next round, so no value grows with its list.
    """
    spark, turn = parts.sparkSession, 0
    while True:
        parts = stages.save(parts, f"{name}-parts-{turn}")
        distinct = stages.save(parts.select("value").distinct(), f"{name}-values-{turn}")
        ranked = rank_rows(distinct, [], ["value"], [], tasks_for(spark, distinct.count()), stages,
                           f"{name}-named-{turn}", keep=["value"])
        named = stages.save(parts.join(ranked, "value").select(*key, "k", "rank"),
                            f"{name}-ranks-{turn}")
        if not named.agg(F.max("k")).first()[0]:
            return named.select(*key, "rank")
        parts = (named.withColumn("name", pack_big_endian(F.col("rank"), 8))
                 .withColumn("at", F.col("k")).withColumn("k", F.expr(f"k div {FAN}"))
                 .groupBy(*key, "k")
                 .agg(F.expr("listagg(name) within group (order by at)").alias("value")))
        turn += 1


def table_names(stars: DataFrame, key: list[str], total: int, stages: Stages,
                name: str) -> tuple[DataFrame, int]:
    """Name rows alike in ``key`` in all texts; also returns the number of names.

    Names ascend with ``key``; of its columns only the first may be long.  One row per distinct
    key is sorted, after combining on the map side.  The names go back by broadcast when the
    table is counted small, else by a shuffle join in which the rows of a frequent key are spread
    over as many tasks as they would fill.  At most one key per task of the exchange counts as
    frequent; only their hashes are broadcast.
    """
    spark = stars.sparkSession
    tasks = tasks_for(spark, total)
    distinct = stages.save(stars.groupBy(*key).count(), f"{name}-distinct")
    n_names, size = distinct.agg(F.count("*"), F.sum(F.octet_length(key[0]))).first()
    # A single group of distinct keys: the rank is the row number.
    named = rank_rows(distinct, [], key, [], tasks_for(spark, n_names), stages, f"{name}-names",
                      keep=[*key, "count"])
    named = named.select(*key, "count", F.col("rank").alias("name"))
    if n_names <= BROADCAST_NAMES and size <= BROADCAST_BYTES:
        return stars.join(F.broadcast(named.drop("count")), key), n_names

    hashed = F.xxhash64(*key)
    frequent = F.broadcast(named.filter(F.col("count") * tasks >= total)
                           .groupBy(hashed.alias("_hash"))
                           .agg(F.max(F.ceil(F.col("count") * tasks / total)).cast("int")
                                .alias("_salts")))

    def salted(df: DataFrame) -> DataFrame:
        return (df.withColumn("_hash", hashed).join(frequent, "_hash", "left")
                .withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_hash"))

    copies = salted(named.drop("count")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    spread = salted(stars).withColumn(
        "_salt", F.pmod("star_idx", "_salts").cast("int")).drop("_salts")
    return spread.join(copies, [*key, "_salt"]).drop("_salt"), n_names
